"""Timelines out of reports and tables of times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Forms of times in texts; those without a zone are UTC.
FORMS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss Z",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss",
)


def parsed_time(value: Column) -> Column:
    """A time out of text: seconds since 1970 or one of many forms, a weekday in front and a remark behind left out."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(value), r"^[A-Za-z]{3,9},?\s+(?=\d)", ""), r"\s*\([^)]*\)\s*$", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s*\b(?:GMT|UTC|UT|Z)$", " +0000")
    number = F.when(text.rlike(r"^-?\d{1,12}(\.\d{1,9})?$"), text.try_cast("double"))
    return F.coalesce(F.timestamp_micros((number * 1_000_000).cast("long")), *[F.try_to_timestamp(text, F.lit(f)) for f in FORMS])


def timeline(*parts: DataFrame) -> DataFrame:
    """Rows with ts, source, event, details in one; those without a time are left out."""
    return reduce(DataFrame.unionByName, [p.select("ts", "source", "event", F.coalesce("details", F.lit("")).alias("details")) for p in parts]).where("ts is not null")


def from_reports(reports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events out of reports labelled date, route, archive and compile_time.

    A report's data is JSON: timestamp, an array of hops (timestamp, from, by), or archive_modified and its companions.
    """
    named = reports.join(nodes.select("node_id", F.coalesce("filename", "mime_type").alias("source")), "node_id")
    data = lambda path: F.get_json_object("data", f"$.{path}")
    row = lambda where, ts, source, event, details: named.where(where).select("root_id", parsed_time(ts).alias("ts"), source.alias("source"), F.lit(event).alias("event"), details.alias("details"))
    hop = F.from_json("data", "array<struct<timestamp:string,from:string,by:string>>")
    hops = named.where("label = 'route'").select("root_id", "source", F.explode(hop).alias("h"))
    parts = [
        row("label = 'date'", F.coalesce(data("timestamp"), F.col("text")), F.col("source"), "Email date", F.col("text")),
        hops.select("root_id", parsed_time(F.col("h.timestamp")).alias("ts"), "source", F.lit("Mail relay hop").alias("event"), F.concat("h.from", F.lit(" -> "), "h.by").alias("details")),
        row("label = 'archive'", data("archive_modified"), F.coalesce(data("archive_filename"), F.col("source")), "Archive member timestamp", F.coalesce(data("archive_type"), F.lit("archive"))),
        row("label = 'compile_time'", data("timestamp"), F.col("source"), "PE compile time", F.col("text")),
    ]
    return reduce(DataFrame.unionByName, parts).where("ts is not null")


def in_order(events: DataFrame) -> DataFrame:
    return events.orderBy("ts", "source", "event", "details")


def lines(events: DataFrame) -> DataFrame:
    """(root_id, ts, line): time, event in 25 columns and source, with details indented below."""
    head = F.concat_ws("  ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat_ws(" ", F.rpad("event", 25, " "), F.col("source")))
    return events.select("root_id", "ts", F.when(F.col("details") == "", head).otherwise(F.concat(head, F.lit("\n    "), F.col("details"))).alias("line"))
