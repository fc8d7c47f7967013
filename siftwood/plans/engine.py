"""Triage: files in, the relations of nodes, reports, indicators, hops and events out.

Nested files are expanded level by level.  A level is one table: its nodes are hashed, typed, dispatched and analysed
together; what they hold is the next level, less what the same file has held before.  Each level is stored, so a lost
executor costs the level at work and no more.
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.config import Flags
from siftwood.functions import content, iocs, reputation, text
from siftwood.operators import hops as hop_ops
from siftwood.operators import rules
from siftwood.operators import timeline as timeline_ops
from siftwood.operators.reports import make_report
from siftwood.plans.analyzers import analysed
from siftwood.runtime import scratch_folder
from siftwood.schema import severity_name


@dataclass
class TriageResult:
    nodes: DataFrame
    reports: DataFrame
    iocs: DataFrame
    hops: DataFrame
    timeline: DataFrame
    gateways: DataFrame
    verdicts: DataFrame
    store: "Store" = field(repr=False)

    def drop(self) -> None:
        """Removes the tables; the frames cannot be read any more."""
        self.store.drop()


class Store:
    """Tables in a folder of their own below spark.checkpoint.dir; they go with drop, or when the driver's Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, scratch_folder(spark, "triage")
        atexit.register(self.drop)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        atexit.unregister(self.drop)
        context = self.spark.sparkContext
        if context._jsc is None:  # the session has ended; the folder is left to its owner
            return
        try:
            target = context._jvm.org.apache.hadoop.fs.Path(self.root)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except (Py4JError, OSError):
            pass  # so has its JVM


def typed(nodes: DataFrame, flags: Flags) -> DataFrame:
    """Nodes with hashes, size and types; a declared type goes before the detected one."""
    raw = F.col("content")
    seen = content.detected(raw, F.col("filename"), flags.mime_provider_order)
    return (
        nodes.withColumns({"size": F.octet_length(raw).cast("long"), **content.hashes(raw), "seen": seen})
        .withColumns({"magic_mime": F.col("seen.mime"), "magic_description": F.col("seen.description"), "mime_type": F.coalesce("declared_mime", "seen.mime")})
        .withColumn("type_mismatch", content.type_mismatch(F.col("declared_mime"), F.col("magic_mime")))
        .drop("seen")
    )


def file_nodes(files: DataFrame, flags: Flags) -> DataFrame:
    """Level 0: files with path, content and, if known, declared_mime; those above the size limit are left out."""
    declared = F.col("declared_mime") if "declared_mime" in files.columns else F.lit(None).cast("string")
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return typed(
        files.where(F.octet_length("content") <= flags.max_file_size).select(
            F.col("path").alias("root_id"), F.col("path").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
            F.array(F.lit(0)).alias("path"), F.lit(0).alias("level"), F.lit(0).alias("idx"), name.alias("filename"), declared.alias("declared_mime"),
            F.create_map().cast("map<string,string>").alias("metadata"), "content",
        ),
        flags,
    )


def _children(nodes: DataFrame, outcomes: DataFrame, flags: Flags) -> DataFrame:
    parents = nodes.select("root_id", "node_id", "path", "level")
    each = outcomes.select("node_id", F.explode("children").alias("c")).join(parents, "node_id")
    place = F.concat(F.col("path"), F.array(F.col("c.idx")))
    raw = each.select(
        "root_id", F.concat_ws("/", "node_id", F.concat(F.lit("#"), F.col("c.idx").cast("string"))).alias("node_id"), F.col("node_id").alias("parent_id"),
        place.alias("path"), (F.col("level") + 1).alias("level"), F.col("c.idx").alias("idx"), F.col("c.filename").alias("filename"),
        F.col("c.declared_mime").alias("declared_mime"), F.col("c.metadata").alias("metadata"), F.col("c.content").alias("content"),
    )
    return typed(raw, flags)


#: Node ids that may be broadcast to a table with contents; beyond it the join shuffles.
FEW_IDS = 200_000


def expand(frontier: DataFrame, seen: DataFrame, flags: Flags, store: Store) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes, outcomes) of a level and all below it.  Of equal contents in one root the first in preorder is analysed.

    A level is hashed and typed once, when it is stored; which of its nodes are new is found by keys alone, and contents
    are fetched by node id at the end.
    """
    levels, outcomes = [], []
    for level in range(flags.max_analysis_depth + 2):
        frontier = store.save(frontier)
        firsts = frontier.groupBy("root_id", "sha256").agg(F.min(F.struct("path", "node_id")).alias("first"))
        ids = store.save(rules.unseen(firsts, seen, "root_id", "sha256").select(F.col("first.node_id").alias("node_id")))
        few = ids.count() <= FEW_IDS
        new = store.save(frontier.join(F.broadcast(ids) if few else ids, "node_id", "left_semi").select(frontier.columns))
        if new.isEmpty():
            break
        seen = seen.unionByName(new.select("root_id", "sha256"))
        done = store.save(analysed(new.where(F.col("level") <= flags.max_analysis_depth), flags))
        levels.append(new.drop("passwords"))
        outcomes.append(done)
        frontier = _children(new, done, flags)
    return levels, outcomes


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _raw_reports(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    return nodes.select("root_id", "node_id").join(outcomes.select("node_id", F.explode("reports").alias("r")), "node_id").select("root_id", "node_id", "r.*")


def _with_passwords(nodes: DataFrame, outcomes: DataFrame, flags: Flags, store: Store) -> tuple[DataFrame, DataFrame]:
    """Locked archives tried with the passwords that texts of the same root gave away, until none opens any more.

    Passwords and archives only grow and depth is bounded, so this ends.
    """
    while True:
        reports = _raw_reports(nodes, outcomes)
        found = reports.where("report_key = 'possible_passwords'").select("root_id", F.explode(F.split("text", "\n")).alias("p"))
        by_root = found.groupBy("root_id").agg(F.array_sort(F.collect_set("p")).alias("passwords"))
        pending = reports.where("report_key = 'pending_password'").select("node_id")
        locked = store.save(nodes.join(pending, "node_id", "left_semi").join(by_root, "root_id"))
        if locked.isEmpty():
            return nodes, outcomes
        again = store.save(analysed(locked, flags))
        opened = store.save(again.where(~F.exists("reports", lambda r: r["report_key"] == "pending_password")))
        if opened.isEmpty():
            return nodes, outcomes
        more, below = expand(_children(locked, opened, flags), nodes.select("root_id", "sha256"), flags, store)
        kept = outcomes.join(opened.select("node_id"), "node_id", "left_anti")
        nodes, outcomes = store.save(_union([nodes, *more])), store.save(_union([kept, opened, *below]))


def _flat(nodes: DataFrame, analyzer: str, reports, seq: int) -> DataFrame:
    """Reports made of node columns; reports is an array of structs."""
    rows = nodes.select("root_id", "node_id", F.explode(F.array_compact(reports)).alias("r"))
    return rows.select("root_id", "node_id", "r.*", F.lit(seq).alias("seq"), F.lit(analyzer).alias("analyzer"))


def _context() -> F.Column:
    parts = (("archive_modified", "Modified in archive: "), ("archive_compress_method", "Compression: "), ("archive_create_system", "Packed on: "), ("archive_create_version", "Packer ZIP version: "), ("archive_unix_permissions", "Unix permissions: "))
    told = F.array_compact(F.array(*[F.concat(F.lit(words), F.col("metadata")[k]) for k, words in parts]))
    report = make_report("_archive_context", F.array_join(told, "\n"), short=F.concat(F.lit("From "), F.coalesce(F.col("metadata")["archive_type"], F.lit("archive"))), label="archive", verbosity=1, order=5, data=F.to_json("metadata"))
    return F.when(F.size(told) > 0, report)


def final_reports(nodes: DataFrame, flags: Flags) -> DataFrame:
    """What every node tells whatever it is: archive context, names, entropy, depth; and indicators and language of texts."""
    size, e, name = F.col("size"), F.col("entropy"), F.col("filename")
    level = content.dangerous_extension(name)
    ext = F.concat(F.lit("."), content.extension(name))
    own = F.array(
        _context(),
        F.when(content.double_extension(name), make_report("double_extension", F.concat(F.lit("Double extension: "), name), label="double_ext", severity=1, order=27)),
        F.when(level.isNotNull(), make_report("dangerous_extension", F.concat(F.lit("Dangerous file type: "), ext, F.lit(" ("), name, F.lit(")")), short=F.concat(F.lit("Dangerous: "), ext), label="dangerous_ext", severity=level, order=28)),
        make_report("entropy", content.entropy_summary(e, size), label="entropy", severity=content.entropy_severity(e, size), verbosity=1, order=88),
        F.when(F.col("level") > flags.max_analysis_depth, make_report("depth_limit", F.lit(f"Nested deeper than {flags.max_analysis_depth} levels: not analysed"), severity=3)),
    )
    every = _flat(nodes.select("root_id", "node_id", "filename", "metadata", "size", "level", content.entropy(F.col("content")).alias("entropy")), "Analyzer", own, 1000)
    texts = nodes.where("mime_type = 'text/plain'").select("root_id", "node_id", text.decoded(F.col("content"))["text"].alias("text"))
    found = texts.select("root_id", "node_id", iocs.indicators(F.col("text")).alias("i"), text.language(F.col("text")).alias("lang"))
    told = F.array(
        F.when(iocs.total(F.col("i")) > 0, make_report("iocs", F.array_join(iocs.summary_lines(F.col("i")), "\n"), short=F.array_join(iocs.summary_parts(F.col("i")), ", "), label="iocs", severity=iocs.severity(F.col("i")), order=40, data=F.to_json("i"))),
        F.when(F.col("lang").isNotNull(), make_report("language", F.col("lang"), label="language", verbosity=1)),
    )
    return every.unionByName(_flat(found, "PlainTextAnalyzer", told, 1001))


#: What a table of hops shows of each.
HOP_CELLS = (
    "hop", "by_hostname", "by_ip", "server_type", "from_name", "from_ip", "annotations", "protocol", "tls", "cipher", "no_tls",
    "timestamp", "tz_offset", "tz_changed", "prev_tz", "delta_seconds", "delta_display", "inferred_after", "footer",
)


def route_reports(hops: DataFrame, gateways: DataFrame | None = None) -> DataFrame:
    """The reports on a message's way, out of all messages' hops at once; gateways as their findings name them."""
    one = lambda key, body, **more: make_report(key, body, **more)
    n = lambda c: F.col(c).cast("string")
    count = hops.groupBy("root_id", "node_id").agg(F.count("*").alias("n"))
    parts = []

    def add(rows: DataFrame, report) -> None:
        parts.append(_flat(rows, "EmailAnalyzer", F.array(report), 900))

    cells = F.array_sort(F.collect_list(F.struct(*HOP_CELLS)))
    tables = hop_ops.display(hops, gateways).groupBy("node_id").agg(F.to_json(F.struct(cells.alias("hops"))).alias("table"))
    add(count.join(hop_ops.route_text(hops), "node_id").join(tables, "node_id", "left"), one("mail_route", F.col("route"), short=F.concat(n("n"), F.lit(" hop(s)")), label="mail_route", verbosity=1, content_type="application/x-hops", data=F.col("table")))
    origin = count.join(hop_ops.origin(hops), "node_id")
    address = F.when(F.col("origin_ip").isNotNull() & (F.col("origin_ip") != F.col("origin_name")), F.concat(F.lit(" ("), "origin_ip", F.lit(")"))).otherwise("")
    add(origin, one("mail_origin", F.concat(F.lit("Origin: "), "origin_name", address, F.lit(" via "), n("n"), F.lit(" hop(s), "), "tls"), short=F.concat(F.lit("Origin: "), "origin_name"), label="origin", order=3))
    joined = lambda rows, by, what: rows.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what]), "\n").alias("body"), F.count("*").alias("k"))
    breaks = joined(hop_ops.chain_breaks(hops), "after_hop", "description")
    add(count.join(breaks, "node_id"), one("chain_breaks", F.col("body"), short=F.concat(n("k"), F.lit(" chain break(s)")), label="chain_break", severity=3, verbosity=1))
    found = hop_ops.latency_anomalies(hops)
    late = joined(found, "hop", "description").join(hop_ops.worst_latency(found), "node_id")
    add(count.join(late, "node_id"), one("latency_anomalies", F.col("body"), short=F.concat(n("k"), F.lit(" timing anomaly(ies)")), label="timing_anomaly", severity=F.col("severity"), verbosity=1))
    clear = hop_ops.without_tls(hops).withColumn("way", F.concat(hop_ops.from_display(), F.lit(" -> "), hop_ops.by_display(), F.when(hop_ops.is_internal(), " (internal)").otherwise("")))
    add(count.join(joined(clear, "place", "way"), "node_id"), one("no_tls", F.concat(F.lit("Hops without TLS:\n  "), F.replace("body", F.lit("\n"), F.lit("\n  "))), label="no_tls", severity=3, verbosity=2))
    hop = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), hop_ops.from_display().alias("from"), hop_ops.by_display().alias("by"))
    data = hops.groupBy("root_id", "node_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", hop.alias("hop")))), lambda x: x["hop"])).alias("data"))
    add(data, one("mail_route_data", F.lit(""), label="route", verbosity=99, data=F.col("data")))
    return _union(parts)


def technique_reports(nodes: DataFrame, reports: DataFrame) -> DataFrame:
    per_node = reports.groupBy("node_id").agg(
        F.collect_set("label").alias("labels"), F.collect_set("report_key").alias("keys"), F.array_join(F.collect_list("text"), " ").alias("behaviour"),
        F.max(F.when(F.col("report_key") == "script_type", F.col("text"))).alias("script_type"),
    )
    rows = nodes.select("root_id", "node_id", "filename", "analyzer").join(per_node, "node_id")
    ids = rules.techniques(F.col("filename"), F.col("analyzer"), F.col("labels"), F.col("behaviour"), F.col("script_type"), keys=F.col("keys"))
    told = rows.withColumn("found", rules.technique_details(ids)).where(F.size("found") > 0)
    lines = F.array_join(F.transform("found", lambda x: F.concat(x["id"], F.lit(" "), x["name"], F.lit(" ("), x["reason"], F.lit(")"))), "\n")
    return _flat(told, "Analyzer", F.array(make_report("mitre_attack", lines, short=F.array_join(F.transform("found", lambda x: x["id"]), ", "), label="mitre_attack", verbosity=1, order=91, data=F.to_json("found"))), 1002)


def analyze(spark: SparkSession, source: str | DataFrame, flags: Flags | None = None, verdicts: DataFrame | None = None) -> TriageResult:
    """Triage of files: a path or glob (folders with all below), or a table with path, content and perhaps declared_mime.

    verdicts: what a reputation service says, as functions.reputation gives it; without it the service is asked, if the
    flags allow that, for every content and for some indicators of each root.
    """
    from siftwood.sources.files import read_files

    flags = flags or Flags.from_session(spark)
    store = Store(spark)
    files = read_files(spark, source, flags) if isinstance(source, str) else source
    first = file_nodes(files, flags)
    levels, outcomes = expand(first, first.select("root_id", "sha256").limit(0), flags, store)
    if not levels:
        levels, outcomes = [store.save(first)], [store.save(analysed(first.limit(0), flags))]
    nodes, done = _with_passwords(store.save(_union(levels)), store.save(_union(outcomes)), flags, store)
    nodes = store.save(nodes.join(done.select("node_id", "analyzer", F.col("info").alias("analyzer_info")), "node_id", "left").withColumn("analyzer", F.coalesce("analyzer", F.lit("Analyzer"))))
    hops = done.select("node_id", F.explode("hops").alias("h")).join(nodes.select("root_id", "node_id"), "node_id").select("root_id", "node_id", "h.*")
    hops = store.save(hop_ops.numbered(hops))
    gateways = store.save(done.select("node_id", F.explode("gateways").alias("g")).select("node_id", "g.*"))
    reports = store.save(_union([_raw_reports(nodes, done), final_reports(nodes, flags), route_reports(hops, gateways)]))
    texts = nodes.where("mime_type = 'text/plain'").withColumn("text", text.decoded(F.col("content"))["text"])
    found = iocs.long_indicators(texts, F.col("text"), "root_id", "node_id", "path")
    if verdicts is None:
        asked = nodes.select(F.lit("file").alias("kind"), F.col("sha256").alias("value")).unionByName(reputation.budgeted(found, flags.max_lookups))
        verdicts = store.save(reputation.lookups(asked, flags)) if reputation.allowed(flags) else spark.createDataFrame([], reputation.VERDICT)
    known = reputation.verdict_reports(nodes, verdicts)
    known = known.withColumn("seq", F.lit(1003)).withColumn("analyzer", F.lit("Analyzer")).select(reports.columns)
    reports = store.save(_union([reports, technique_reports(nodes, reports), known]))
    return TriageResult(nodes, reports, found, hops, timeline_ops.from_reports(reports, nodes), gateways, verdicts, store)


def identity(result: TriageResult) -> DataFrame:
    """One row for each root: how many nodes and findings it has, and the worst severity in its tree."""
    worst = result.reports.groupBy("root_id").agg(F.min("severity").alias("severity"), F.count_if(F.col("severity") <= 2).alias("findings"))
    sums = result.nodes.groupBy("root_id").agg(F.count("*").alias("nodes"), F.max("level").alias("depth"))
    return sums.join(worst, "root_id", "left").withColumn("worst", severity_name(F.coalesce("severity", F.lit(4)))).drop("severity")
