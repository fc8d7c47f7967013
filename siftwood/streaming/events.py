"""Streams of events and files: windows with late data, counters, first sight of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.functions import content
from siftwood.operators.rules import increment
from siftwood.sources.sinks import KeyValueStore


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events by type in tumbling, or sliding, windows; what comes later than late after the newest is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every, slide), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def new_contents(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Files of a stream, each content once as long as the watermark remembers it."""
    seen = files.withColumn("sha256", content.hashes(F.col("content"))["sha256"])
    return seen.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"])


def count_into(events: DataFrame, store: KeyValueStore, namespace: str, checkpoint: str):
    """Keeps counters of keys (key, updated_at) in a store; a batch that is repeated counts once.

    Each batch's sums replace what a failed attempt of the same batch left, so values are sums over batch ids.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = increment(batch, "key")
        rows = sums.select(F.lit(f"{namespace}:{batch_id}").alias("namespace"), "key", F.to_json(F.struct("n", "last_seen")).alias("value"), F.col("last_seen").alias("updated_at"))
        store.set(rows)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(store: KeyValueStore, namespace: str) -> DataFrame:
    """(key, n, last_seen) over all batches."""
    rows = store.read().where(F.split_part("namespace", F.lit(":"), F.lit(1)) == namespace)
    value = F.from_json("value", "n long, last_seen timestamp")
    return rows.groupBy("key").agg(F.sum(value["n"]).alias("n"), F.max(value["last_seen"]).alias("last_seen"))
