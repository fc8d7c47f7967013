"""Findings of nodes: view, order, suppression, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest text shown below verbosity 2.
SHOWN = 2048


def make_report(key: str, text: Column, *, short: Column | None = None, label: str = "", severity=4, verbosity: int = 0, order: int = 50, data: Column | None = None, replaces: str | None = None, content_type: str = "text/plain") -> Column:
    """A finding as a struct; severity is a number or a column, and short defaults to the text."""
    return F.struct(
        F.lit(key).alias("report_key"),
        F.lit(label).alias("label"),
        (severity if isinstance(severity, Column) else F.lit(int(severity))).cast("int").alias("severity"),
        F.lit(verbosity).alias("verbosity"),
        F.lit(order).alias("ord"),
        text.cast("string").alias("text"),
        (short if short is not None else text).cast("string").alias("short"),
        F.lit(content_type).alias("content_type"),
        (data if data is not None else F.lit(None)).cast("string").alias("data"),
        F.lit(replaces).cast("string").alias("replaces"),
    )


def shown(reports: DataFrame, verbosity: int, *node: str) -> DataFrame:
    """What a reader at a verbosity sees: no more detailed reports, none that another one there replaces, long texts cut."""
    seen = reports.where(F.col("verbosity") <= verbosity)
    replaced = seen.where(F.col("replaces").isNotNull()).select(*node, F.col("replaces").alias("label")).distinct()
    left = seen.join(replaced, [*node, "label"], "left_anti")
    if verbosity < 2:
        left = left.withColumn("text", F.when(F.length("text") > SHOWN, F.concat(F.left("text", F.lit(SHOWN)), F.lit("…"))).otherwise(F.col("text")))
    return left.select(reports.columns)


def in_order(reports: DataFrame, *node: str) -> DataFrame:
    """With place: by severity, then the report's order, then as found."""
    return reports.withColumn("place", F.row_number().over(Window.partitionBy(*node).orderBy("severity", "ord", "seq")))


def top(reports: DataFrame, n: int, *node: str) -> DataFrame:
    return in_order(reports, *node).where(F.col("place") <= n)


def worst_own(nodes: DataFrame, reports: DataFrame, *node: str) -> DataFrame:
    """The worst severity of each node's own reports; INFO where it has none."""
    own = reports.groupBy(*node).agg(F.min("severity").alias("severity"))
    return nodes.select(*node).join(own, [*node], "left").select(*node, F.coalesce("severity", F.lit(4)).alias("severity"))


def worst_of_subtree(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(node_id, severity): the worst of a node and of all below it.

    nodes: node_id and ancestors, an array of ids from the root to the node itself.  Each row counts for each of its
    ancestors; partial aggregates keep what moves to a row for each ancestor and task.
    """
    each = nodes.join(own, "node_id").select(F.explode("ancestors").alias("node_id"), "severity")
    return each.groupBy("node_id").agg(F.min("severity").alias("severity"))


def merge_contributors(reports: DataFrame, *node: str) -> DataFrame:
    """Reports of the primary analyser, and those of others under keys that it leaves free, errors apart.

    reports has is_primary and specificity; of several others with one key the least specific one counts, which ran first.
    """
    allowed = reports.where(F.col("is_primary") | (F.col("label") != "error"))
    order = Window.partitionBy(*node, "report_key").orderBy(F.col("is_primary").desc(), "specificity", "seq")
    return allowed.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def display_class(text: Column, label: Column, severity: Column) -> Column:
    """How a report is shown: source code, body text, a listing of files, a line of metadata, or plainly."""
    lines = F.split(text, "\n")
    listing = F.exists(F.slice(lines, 1, 5), lambda x: x.rlike(r"^\s*\[\d+\]") | F.contains(x, F.lit("<encrypted>")))
    several = F.size(lines) > 1
    code = text.rlike(r"(?im)^\s*(?:attribute vb_|(?:public |private )?(?:sub|function) \w)")
    return (
        F.when(code, F.lit("vba"))
        .when(listing, F.lit("file_listing"))
        .when((F.coalesce(label, F.lit("")) == "") & several & (F.length(text) > 100), F.lit("body_text"))
        .when((F.coalesce(label, F.lit("")) != "") & (severity == 4) & ~several, F.lit("metadata"))
        .otherwise(F.lit("plain"))
    )


def providers_by_answer(detections: DataFrame, *node: str) -> DataFrame:
    """Detections with one answer in a row, with those who gave it."""
    return detections.groupBy(*node, "mime", "description").agg(F.array_sort(F.collect_set("provider")).alias("providers"))
