"""What a run writes: extracted files, lists and tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions import content


def extraction_plan(nodes: DataFrame, names: bool = False, numbered: bool = False) -> DataFrame:
    """(node_id, target, content): the file that each node becomes; nested ones below folders called children.

    names: under the sanitised name, else the hash and the type's extension; numbered: hash, place and name in one.
    """
    given = content.effective_filename(F.col("filename"), F.col("md5"), F.col("magic_mime"))
    made = content.generated_filename(F.col("md5"), F.col("magic_mime"))
    name = F.concat_ws("-", "md5", F.col("idx").cast("string"), content.sanitized_filename(given)) if numbered else content.sanitized_filename(given) if names else made
    name = F.replace(name, F.lit("\\"), F.lit("_"))
    folder = F.repeat(F.lit("children/"), F.col("level"))
    return nodes.select("node_id", F.concat(folder, name).alias("target"), "content")


def extract(nodes: DataFrame, folder: str, names: bool = False, numbered: bool = False) -> DataFrame:
    """Writes each node's bytes below a folder that all machines share; gives (node_id, target, size, written).

    The folder is a path, or an address of any store that Arrow's file systems reach (file, hdfs, s3, gs).  A file is
    written beside its place and moved, so a repeated task leaves one whole file.
    """

    def write(batches: Iterator) -> Iterator:
        import os
        import posixpath

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder.removeprefix("file:")))
        base = posixpath.normpath(base)
        for batch in batches:
            done = []
            for target, raw in zip(batch.column("target").to_pylist(), batch.column("content").to_pylist()):
                path = posixpath.normpath(posixpath.join(base, target))
                ok = path.startswith(base + "/")
                if ok:
                    store.create_dir(posixpath.dirname(path), recursive=True)
                    staged = f"{path}.{uuid.uuid4().hex}"
                    with store.open_output_stream(staged) as out:
                        out.write(raw or b"")
                    store.move(staged, path)
                done.append(ok)
            size = pa.array([len(r or b"") for r in batch.column("content").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node_id"), batch.column("target"), size, pa.array(done, pa.bool_())], names=["node_id", "target", "size", "written"])

    return extraction_plan(nodes, names, numbered).mapInArrow(write, "node_id string, target string, size long, written boolean")


def mail_dump(files: DataFrame) -> DataFrame:
    """(path, dump): a message file as text: its hashes, from, to, date and subject, and its parts as an indented list.

    files: path and content.  A file that is no message has its hashes alone.
    """
    from siftwood.functions import mail

    parsed = mail.parsed_mail(files, "path")
    h = {k: v.alias(k) for k, v in content.hashes(F.col("content")).items()}
    marked = files.select("path", *[h[k] for k in ("md5", "sha1", "sha256")])
    said = lambda name, words: F.transform(F.filter("headers", lambda x: F.lower(x["name"]) == name), lambda x: F.concat(F.lit(words), F.array_join(x["decoded"], " ")))
    line = lambda words, c: F.concat(F.lit(words), c)

    def part(p):
        indent = F.repeat(F.lit("    "), p["level"])
        clip = F.contains(F.coalesce(p["disposition"], F.lit("")), F.lit("attachment"))
        shown = F.concat(indent, F.rpad(p["part_index"].cast("string"), 4, "_"), p["content_type"], F.when(clip, F.lit(" (attachment)")).otherwise(F.lit("")))
        rows = [F.when(p[c].isNotNull(), F.concat(indent, F.lit(f"    {c:<9}: "), p[c].cast("string"))) for c in ("filename", "md5", "sha1", "sha256")]
        return F.concat(F.array(shown), F.array_compact(F.array(*rows)))

    joined = marked.join(parsed, F.col("path") == F.col("node_id"), "left")
    head = F.array(line("File   : ", F.col("path")), line("MD5    : ", F.col("md5")), line("SHA1   : ", F.col("sha1")), line("SHA256 : ", F.col("sha256")))
    fields = F.flatten(F.array(said("from", "From   : "), said("to", "To     : "), said("date", "Date   : "), said("subject", "Subject: ")))
    body = F.when(F.col("status") == "done", F.concat(fields, F.array(F.lit("Parts:")), F.flatten(F.transform("parts", part))))
    none = F.array().cast("array<string>")
    return joined.select("path", F.array_join(F.concat(head, F.coalesce(body, none)), "\n").alias("dump"))


def mail_csv(summary: DataFrame) -> DataFrame:
    """(value): one quoted line for each message: file, subject, date, from, to."""
    q = lambda c: F.concat(F.lit('"'), F.coalesce(F.col(c).cast("string"), F.lit("None" if c == "date" else "")), F.lit('"'))
    return summary.select(F.concat_ws(",", *[q(c) for c in ("node_id", "subject", "date", "from", "to")]).alias("value"))


def hop_csv(hops: DataFrame) -> DataFrame:
    """(value): hops parted by semicolons; those in values become commas, blanks one."""
    clean = lambda c: F.trim(F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(";"), F.lit(",")), r"\s+", " "))
    return hops.select(F.concat_ws(";", *[clean(c) for c in ("node_id", "ts", "from_name", "from_ip", "by_hostname", "protocol", "id")]).alias("value"))


def senders(mail_headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all senders in order, messages whose From holds several different addresses)."""
    found = mail_headers.where(F.lower("name") == "from").select("node_id", F.regexp_extract_all(F.lower("raw"), F.lit(r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"), F.lit(0)).alias("addresses"))
    every = found.select(F.explode("addresses").alias("sender")).distinct().orderBy("sender")
    return every, found.where(F.size(F.array_distinct("addresses")) > 1)


class KeyValueStore:
    """Namespaced JSON values with counters, below a folder that all machines share.

    A change is a table of its own, written under a unique name and renamed into place, so writers never meet and
    readers see whole changes only.  What holds of a key is its latest row, by time and then by change.  `compact` folds
    changes into one table with a list of what it stands for; deletions do so too.  Folded tables go at the next fold, so
    that readers which began before it come to their end.  A table that cannot be read fails the read, unless lenient:
    then it counts as empty.
    """

    SCHEMA = "namespace string, key string, value string, updated_at timestamp"
    STORED = SCHEMA + ", change string"

    def __init__(self, spark: SparkSession, path: str, lenient: bool = False):
        self.spark, self.path, self.lenient = spark, path.rstrip("/"), lenient
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, kind: str) -> list[str]:
        folder = self._at(kind)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _live(self) -> tuple[list[str], list[str]]:
        """(paths that count, names that the newest fold stands for)."""
        folds = self._names("folds")
        gone = [r["name"] for r in self.spark.read.schema("name string").json(f"{self.path}/ledgers/{folds[-1]}").collect()] if folds else []
        changes = [f"{self.path}/changes/{n}" for n in self._names("changes") if n not in set(gone)]
        return changes + [f"{self.path}/folds/{n}" for n in folds[-1:]], gone

    def _rows(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.STORED)
        return self.spark.read.schema(self.STORED).option("ignoreCorruptFiles", str(self.lenient).lower()).parquet(*paths)

    def read(self) -> DataFrame:
        return self._latest(self._rows(self._live()[0])).drop("change")

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("value", "updated_at", "change"), F.struct("updated_at", "change", "value"))
        return rows.groupBy("namespace", "key").agg(last.alias("x")).select("namespace", "key", "x.value", "x.updated_at", "x.change")

    def _place(self, rows: DataFrame, kind: str, name: str) -> None:
        staged = f"staged/{name}"
        rows.write.parquet(f"{self.path}/{staged}")
        self._fs.mkdirs(self._at(kind))
        if not self._fs.rename(self._at(staged), self._at(f"{kind}/{name}")):
            raise RuntimeError(f"{name} could not be renamed into place")

    @staticmethod
    def _name() -> str:
        return f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def set(self, rows: DataFrame) -> None:
        name = self._name()
        named = rows.select("namespace", "key", "value", "updated_at", F.lit(name).alias("change"))
        self._place(self._latest(named), "changes", name)

    def compact(self, keep=None) -> None:
        """Folds what counts into one table; keep: a function of the rows that says which stay."""
        paths, gone = self._live()
        rows = self._latest(self._rows(paths))
        name, names = self._name(), [p.rpartition("/")[2] for p in paths]
        ledger = self.spark.createDataFrame([(n,) for n in names], "name string")
        ledger.write.json(f"{self.path}/ledgers/{name}")
        older = self._names("folds")
        self._place(keep(rows) if keep else rows, "folds", name)
        for n in gone:  # what the fold before this one stood for
            self._fs.delete(self._at(f"changes/{n}"), True)
        for n in older[:-1]:
            self._fs.delete(self._at(f"folds/{n}"), True)
            self._fs.delete(self._at(f"ledgers/{n}"), True)

    def get(self, namespace: str, key: str, default: str | None = None) -> str | None:
        found = self.read().where((F.col("namespace") == namespace) & (F.col("key") == key)).select("value").first()
        return found["value"] if found else default

    def has(self, namespace: str, key: str) -> bool:
        return self.get(namespace, key) is not None

    def delete(self, keys: DataFrame) -> int:
        from siftwood.operators import rules

        gone = self.read().join(keys, ["namespace", "key"], "left_semi").count()
        if gone:
            self.compact(lambda rows: rules.delete(rows, keys).select(rows.columns))
        return gone

    def increment(self, namespace: str, key: str, field: str, amount: int = 1) -> None:
        """Adds to a number in a JSON object; a missing or other value starts anew."""
        import json

        try:
            value = json.loads(self.get(namespace, key) or "{}")
        except ValueError:
            value = {}
        value = value if isinstance(value, dict) else {}
        value[field] = value.get(field, 0) + amount
        self._put(namespace, key, json.dumps(value))

    def touch(self, namespace: str, key: str) -> None:
        """Notes when an object was last seen; nothing for other values."""
        import json
        from datetime import datetime, timezone

        value = json.loads(self.get(namespace, key) or "null")
        if isinstance(value, dict):
            self._put(namespace, key, json.dumps(value | {"last_seen": datetime.now(timezone.utc).isoformat()}))

    def _put(self, namespace: str, key: str, value: str) -> None:
        rows = self.spark.createDataFrame([(namespace, key, value)], "namespace string, key string, value string")
        self.set(rows.withColumn("updated_at", F.current_timestamp()))

    def clear(self, namespace: str | None = None) -> None:
        self.compact(lambda rows: rows.where(F.col("namespace") != namespace) if namespace else rows.limit(0))

    def size(self, namespace: str) -> int:
        return self.read().where(F.col("namespace") == namespace).count()
