"""Rules over findings: techniques, anti-joins of parts and references, guards, first matches, key-value upserts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftwood.functions.signatures import SignatureIndex
from siftwood.runtime import scratch_folder, ship

# Technique id, name and reason, in the order of the rules.
TECHNIQUES = {
    "T1221": ("Template Injection", "Remote Office template relationship"),
    "T1204.002": ("User Execution: Malicious File", "VBA macro-enabled document"),
    "T1027.013": ("Obfuscated Files or Information: Encrypted Archive", "Encrypted container or archive"),
    "T1059.007": ("Command and Scripting Interpreter: JavaScript", "JavaScript or HTA payload"),
    "T1059.001": ("Command and Scripting Interpreter: PowerShell", "PowerShell payload or invocation"),
    "T1059.005": ("Command and Scripting Interpreter: Visual Basic", "VBScript or WSH payload"),
    "T1059.003": ("Command and Scripting Interpreter: Windows Command Shell", "Batch or command shell payload"),
    "T1105": ("Ingress Tool Transfer", "Download cradle detected"),
    "T1027": ("Obfuscated Files or Information", "Heavy obfuscation detected"),
    "T1547.001": ("Boot or Logon Autostart Execution: Registry Run Keys", "Registry persistence"),
    "T1053": ("Scheduled Task/Job", "Task scheduler persistence"),
    "T1218.005": ("System Binary Proxy Execution: Mshta", "Mshta execution"),
    "T1218.011": ("System Binary Proxy Execution: Rundll32", "Rundll32 execution"),
}


def techniques(filename: Column, analyzer: Column, labels: Column, behaviour: Column, script_type: Column, strict: bool = False, keys: Column | None = None) -> Column:
    """Technique ids of a node, in rule order.

    labels: array of the reports' labels; keys: of their keys, which count as labels unless strict; behaviour: the
    reports' texts in one; script_type: the text of the report on that.
    """
    name, text, kind = F.lower(F.coalesce(filename, F.lit(""))), F.lower(F.coalesce(behaviour, F.lit(""))), F.lower(F.coalesce(script_type, F.lit("")))
    if keys is not None and not strict:
        labels = F.array_union(labels, keys)
    has = lambda *names: F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names]))
    ends = lambda *exts: name.rlike(r"\.(" + "|".join(exts) + ")$")
    says = lambda *words: F.lit(False) if not words else F.coalesce(text.rlike("|".join(w.replace(".", r"\.") for w in words)), F.lit(False))
    script = analyzer == "ScriptAnalyzer"
    holds = {
        "T1221": has("remote_template"),
        "T1204.002": has("macros_found", "vba_macros", "has_vba", "vba_analysis") | (analyzer == "VBAProjectAnalyzer"),
        "T1027.013": has("encryption"),
        "T1059.007": script & (ends("js", "jse", "hta") | kind.rlike("javascript|html application")),
        "T1059.001": script & (ends("ps1", "psm1") | kind.contains("powershell") | says("powershell invocation")),
        "T1059.005": script & (ends("vbs", "vbe", "wsf", "wsh") | kind.contains("vbscript")),
        "T1059.003": script & (ends("bat", "cmd") | says("cmd.exe invocation")),
        "T1105": says("download cradle", "ingress tool transfer"),
        "T1027": says("obfuscation score") & says("high", "critical"),
        "T1547.001": says("registry") & says("run"),
        "T1053": says("scheduled task", "schtasks"),
        "T1218.005": says("mshta"),
        "T1218.011": says("rundll32"),
    }
    return F.array_compact(F.array(*[F.when(holds[t], F.lit(t)) for t in TECHNIQUES]))


def technique_details(ids: Column) -> Column:
    known = F.create_map(*[x for t, (n, r) in TECHNIQUES.items() for x in (F.lit(t), F.struct(F.lit(t).alias("id"), F.lit(n).alias("name"), F.lit(r).alias("reason")))])
    return F.transform(ids, lambda t: known[t])


def dangling(references: DataFrame, parts: DataFrame, on: list[str]) -> DataFrame:
    """References to parts that are not there."""
    return references.join(parts.select(*on), on, "left_anti")


def orphans(parts: DataFrame, references: DataFrame, on: list[str]) -> DataFrame:
    """Parts that nothing refers to."""
    return parts.join(references.select(*on), on, "left_anti")


def conflicting(types: DataFrame, *part: str, value: str) -> DataFrame:
    """Parts with more than one declared type, and these."""
    return types.groupBy(*part).agg(F.array_sort(F.collect_set(value)).alias("types")).where(F.size("types") > 1)


def archive_guard(members: DataFrame, *archive: str, packed: str, unpacked: str, ratio: int = 100, most: int = 1 << 30) -> DataFrame:
    """Totals of each archive and whether it may be unpacked, before anything is."""
    sums = members.groupBy(*archive).agg(F.count("*").alias("members"), F.sum(unpacked).alias("unpacked"), F.max(packed).alias("packed"))
    bomb = (F.col("unpacked") > ratio * F.col("packed")) | (F.col("unpacked") > most)
    return sums.withColumn("bomb", bomb)


def traverses(name: Column) -> Column:
    """A path with a step up."""
    return F.array_contains(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), "..")


def absolute(name: Column) -> Column:
    return F.replace(name, F.lit("\\"), F.lit("/")).startswith("/") | name.rlike("^[A-Za-z]:")


def encrypted(flags: Column) -> Column:
    return flags.bitwiseAND(1) == 1


def first_match(value: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first pattern that the value matches."""
    return F.coalesce(*[F.when(value.rlike(p), F.lit(label)) for p, label in table])


def contained(texts: DataFrame, text: Column, signatures: DataFrame, signature: str, *keys: str, most: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Signatures that a text contains, the first by ord for each row of texts.

    Signatures go in blocks of about most rows and most_bytes bytes; a task holds one block at a time.  Beyond one block
    the texts are stored once with row numbers, and the first of the blocks' finds is told.
    """
    spark = texts.sparkSession
    ship(spark)
    listed = signatures.select("ord", signature).where(F.col(signature).isNotNull())
    n, size = listed.agg(F.count("*"), F.sum(F.octet_length(signature))).first()
    blocks = max(1, -(-n // most), -(-(size or 0) // most_bytes))
    fields = [texts.schema[k] for k in keys]
    rows = texts.select(*[F.col(k).alias(f"c{i}") for i, k in enumerate(keys)], text.cast("binary").alias("raw"))
    kinds = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)]
    if blocks > 1:
        path = f"{scratch_folder(spark, 'signatures')}/texts"
        rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
        rows = spark.read.parquet(path)
        kinds.append(T.StructField("row", T.LongType()))
    out = T.StructType([*kinds, T.StructField("ord", listed.schema["ord"].dataType), T.StructField("signature", T.StringType())])
    parts = []
    for k in range(blocks):
        found = listed.where(F.pmod(F.xxhash64(signature), F.lit(blocks)) == k).collect()
        block = sorted(((r["ord"], r[signature]) for r in found), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        sent = spark.sparkContext.broadcast((SignatureIndex([w.encode() for _, w in block]), [o for o, _ in block]))
        parts.append(rows.mapInArrow(_containing(sent, to_arrow_schema(out)), out))
    hits = reduce(DataFrame.unionByName, parts)
    if blocks > 1:
        hits = hits.groupBy("row", *[f"c{i}" for i in range(len(keys))]).agg(F.min(F.struct("ord", "signature")).alias("hit")).select("*", "hit.*")
    return hits.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keys)], "ord", F.col("signature").alias(signature))


def _containing(sent, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ords = sent.value
        kept = schema.names[:-2]
        for batch in batches:
            found = [(i, k) for i, raw in enumerate(batch.column("raw")) if raw.is_valid and (k := index.first(raw.as_py())) is not None]
            if found:
                at = pa.array([i for i, _ in found], pa.int64())
                told = [pa.array([ords[k] for _, k in found], schema.field("ord").type), pa.array([index.signatures[k].decode() for _, k in found])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), *told], names=schema.names)

    return run


# --- key-value tables: namespace, key, value, updated_at ----------------------------------------------------------


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The latest value of each key of both tables."""
    latest = F.max_by(F.struct("value", "updated_at"), F.struct("updated_at", "value"))
    return stored.unionByName(new).groupBy("namespace", "key").agg(latest.alias("v")).select("namespace", "key", "v.*")


def delete(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys, ["namespace", "key"], "left_anti")


def increment(events: DataFrame, *key: str, amount: Column | None = None) -> DataFrame:
    """Counters: the sum of amounts, 1 each unless given, and when each was last touched."""
    return events.groupBy(*key).agg(F.sum(amount if amount is not None else F.lit(1)).cast("long").alias("n"), F.max("updated_at").alias("last_seen"))


def first_seen(nodes: DataFrame, content: str, *order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """One row for each content, the first by order, and how often it occurs."""
    columns = [c for c in nodes.columns if c not in (*within, content)]
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return nodes.groupBy(*within, content).agg(first.alias("first"), F.count("*").alias("occurrences")).select(*within, content, "first.*", "occurrences")


def unseen(nodes: DataFrame, seen: DataFrame, *on: str) -> DataFrame:
    return nodes.join(seen.select(*on), list(on), "left_anti")


def best_analyzer(candidates: DataFrame, *node: str) -> DataFrame:
    """The most specific candidate; of equals the one registered last."""
    return candidates.groupBy(*node).agg(F.max_by("analyzer", F.struct("specificity", "registered")).alias("analyzer"))


def top_per_group(rows: DataFrame, n: int, group: list[str], order: list) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)
