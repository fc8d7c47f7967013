"""Pieces that several operators share: scratch tables, size-checked broadcasts, byte-level words."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.runtime import scratch_folder

#: ASCII white space as used by every word pattern here: space and \x09-\x0D; bytes.split() splits on the same.
WHITE = b" \t\n\x0b\x0c\r"
#: A-Z to a-z, everything else unchanged (safe on UTF-8: multi-byte sequences hold no ASCII).
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every other ASCII character that is no digit or a-z into a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class Scratch:
    """Tables written once and read back, so that lineage is cut and lost executors cost no recomputation.

    They live below ``spark.checkpoint.dir`` (a folder all machines share); only where that is unset, as in local
    tests, a temporary folder is made.  The folder goes when the driver's Python ends; ``drop`` removes one early.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = scratch_folder(spark, "siftwood")
        self._paths: dict[int, str] = {}
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended before; the folder is then left to its owner
            pass

    def save(self, df: DataFrame, rows: int | None = None, rows_per_task: int = 500_000) -> DataFrame:
        """rows: how many there are at most, where that is known; so a small table is written by few tasks, not by one for
        each partition of the shuffle before it."""
        if rows is not None:
            df = df.coalesce(tasks_for(self.spark, rows, rows_per_task))
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._siftwood_scratch = path  # keeps the id of a collected frame from being mistaken for this one
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_siftwood_scratch", None)
        if path:
            self._remove(path)


def sized_broadcast(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """Hints a broadcast only where rows x row_bytes is within limit_bytes; else the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit_bytes else df


def drop_ids(docs: DataFrame, ids: DataFrame, n_ids: int, id_col: str = "doc_id") -> DataFrame:
    """Documents whose id is not in ids (its one column); broadcast if there are few, shuffled by id beyond that.

    Documents with a null id stay.  No name of docs is used, so none can clash.
    """
    if not n_ids:
        return docs
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = ids.toDF("gone").distinct()
    left = rows.join(sized_broadcast(key, n_ids, 16), F.col(f"c{names.index(id_col)}") == F.col("gone"), "left_anti")
    return left.toDF(*names)


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions for a repartition: by the rows that a task may hold, and no fewer than there are cores to use."""
    return max(1, -(-rows // rows_per_task), min(spark.sparkContext.defaultParallelism, -(-rows // 4096)))


def filter_rows(docs: DataFrame, text_col: str, decide: Callable[[], Callable[[pa.RecordBatch], list[bool]]], needs: tuple[str, ...] = ()) -> DataFrame:
    """The rows of docs that decide keeps, all columns as they are, without a shuffle.

    decide() is called once in each task and gives the decision on a batch, whose columns are `raw` (the text's UTF-8
    bytes, empty for null) and one for each of needs, under that name (null where docs has no such column).  No name of
    docs is used, so none can clash.
    """
    fields = docs.schema.fields
    rows = docs.select(
        *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)],
        *[(F.col(f"`{n}`") if n in docs.columns else F.lit(None)).cast("double").alias(f"n{i}") for i, n in enumerate(needs)],
    )
    at_text = [f.name for f in fields].index(text_col)

    def run(batches, size: int = 512):
        keep = decide()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                raw = part.column(at_text).cast(pa.binary()).fill_null(b"")
                seen = pa.RecordBatch.from_arrays(
                    [raw, *(part.column(len(fields) + i) for i in range(len(needs)))], names=["raw", *needs]
                )
                kept = part.filter(pa.array(keep(seen), pa.bool_()))
                if kept.num_rows:
                    yield kept.select(range(len(fields)))

    out = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return rows.mapInArrow(run, out).toDF(*[f.name for f in fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_text(col: str) -> "F.Column":
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))
