"""Relay hops as windows over a message's ordered headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(hops: DataFrame, node: str = "node_id", pos: str = "pos") -> DataFrame:
    """hop_no from 1, the oldest first: headers stand newest first, so places count backwards."""
    return hops.withColumn("hop_no", F.row_number().over(Window.partitionBy(node).orderBy(F.col(pos).desc())))


def _along(node: str) -> Window:
    return Window.partitionBy(node).orderBy("hop_no")


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b, cut towards zero."""
    return ((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1_000_000).cast("long")


def delta_text(seconds: Column) -> Column:
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    s = lambda c: c.cast("string")
    return (
        F.when(seconds < 0, F.concat(s(seconds), F.lit("s SKEW")))
        .when(seconds < 60, F.concat(s(seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(s(minutes), F.lit("m"), s(seconds % 60), F.lit("s")))
        .otherwise(F.concat(s(hours), F.lit("h"), s(F.floor(seconds % 3600 / 60)), F.lit("m")))
    )


def with_deltas(hops: DataFrame, node: str = "node_id") -> DataFrame:
    """delta_seconds and delta_text to the hop before; null for the first and where a time is missing."""
    delta = seconds_between(F.lag("ts").over(_along(node)), F.col("ts"))
    return hops.withColumn("delta_seconds", delta).withColumn("delta_display", F.when(F.col("delta_seconds").isNotNull(), delta_text(F.col("delta_seconds"))).otherwise(""))


def with_zone_changes(hops: DataFrame, node: str = "node_id") -> DataFrame:
    """prev_tz is the last zone known before, however far back; tz_changed tells whether the hop's own differs."""
    before = F.last(F.nullif(F.col("tz_offset"), F.lit("")), ignorenulls=True).over(_along(node).rowsBetween(Window.unboundedPreceding, -1))
    out = hops.withColumn("__prev", before)
    changed = F.coalesce(F.col("__prev").isNotNull() & (F.coalesce("tz_offset", F.lit("")) != "") & (F.col("tz_offset") != F.col("__prev")), F.lit(False))
    return out.withColumn("tz_changed", changed).withColumn("prev_tz", F.when(changed, F.col("__prev")).otherwise("")).drop("__prev")


def anomaly(seconds: Column) -> Column:
    return F.when(seconds < -300, F.lit("possible_forgery")).when(seconds < -5, F.lit("clock_skew")).when(seconds > 86400, F.lit("long_delay"))


def latency_anomalies(hops: DataFrame, node: str = "node_id") -> DataFrame:
    """(node, hop, type, delta_seconds, description): hops after which time runs back or stands still for a day."""
    seconds = seconds_between(F.col("ts"), F.lead("ts").over(_along(node)))
    found = hops.select(node, F.col("hop_no").alias("hop"), seconds.alias("delta_seconds")).withColumn("type", anomaly(F.col("delta_seconds"))).where("type is not null")
    way = F.concat(F.lit("Hop "), F.col("hop").cast("string"), F.lit(" -> "), (F.col("hop") + 1).cast("string"), F.lit(": "))
    s = F.col("delta_seconds").cast("string")
    words = (
        F.when(F.col("type") == "possible_forgery", F.concat(way, s, F.lit("s, so far back that headers may be forged")))
        .when(F.col("type") == "clock_skew", F.concat(way, s, F.lit("s, clocks disagree")))
        .otherwise(F.concat(way, F.floor(F.col("delta_seconds") / 3600).cast("string"), F.lit("h until the next hop")))
    )
    return found.select(node, "hop", "type", "delta_seconds", words.alias("description"))


def worst_latency(anomalies: DataFrame, node: str = "node_id") -> DataFrame:
    """The least delta of each message's anomalies; MEDIUM below -300 seconds, else LOW."""
    return anomalies.groupBy(node).agg(F.min("delta_seconds").alias("worst_delta")).withColumn("severity", F.when(F.col("worst_delta") < -300, 2).otherwise(3))


def _host(c: str) -> Column:
    return F.rtrim(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("."))


def from_display() -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("from_name", "from_hostname", "from_ip", "from_ipv6")], F.lit("?"))


def by_display() -> Column:
    return F.coalesce(F.nullif(F.col("by_hostname"), F.lit("")), F.nullif(F.col("by_ip"), F.lit("")), F.lit("?"))


def has_tls() -> Column:
    return (F.coalesce("tls", F.lit("")) != "") | (F.coalesce("cipher", F.lit("")) != "")


def is_internal() -> Column:
    ip = F.coalesce(F.nullif(F.col("from_ip"), F.lit("")), F.nullif(F.col("from_ipv6"), F.lit("")), F.lit(""))
    second = F.split_part(ip, F.lit("."), F.lit(2)).try_cast("int")
    return (
        ip.startswith("127.") | (ip == "::1") | ip.startswith("10.") | ip.startswith("192.168.")
        | (ip.startswith("172.") & F.coalesce(second.between(16, 31), F.lit(False))) | F.lower(ip).startswith("fe80:")
    )


def chain_breaks(hops: DataFrame, node: str = "node_id") -> DataFrame:
    """Neighbours where the next hop's sender is not this hop's receiver, by name, by address or by first label."""
    nexts = {c: F.lead(c).over(_along(node)) for c in ("from_name", "from_hostname", "from_ip")}
    rows = hops.select(
        "*", by_display().alias("__by"), F.lead(from_display()).over(_along(node)).alias("__to"),
        *[v.alias(f"__{c}") for c, v in nexts.items()],
    ).where("__to is not null")
    by, name, host = _host("by_hostname"), _host("__from_name"), _host("__from_hostname")
    label = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    same = (
        ((by != "") & ((by == name) | (by == host)))
        | ((F.coalesce("by_ip", F.lit("")) != "") & F.col("by_ip").eqNullSafe(F.col("__from_ip")))
        | ((by != "") & (name != "") & (label(by) == label(name)))
    )
    n = F.col("hop_no")
    words = F.concat(F.lit("Hop "), n.cast("string"), F.lit(" ended at "), F.col("__by"), F.lit(", but hop "), (n + 1).cast("string"), F.lit(" began at "), F.col("__to"))
    first = F.coalesce(F.nullif(F.col("by_hostname"), F.lit("")), F.col("by_ip"))
    return rows.where(~same).select(node, n.alias("after_hop"), (n + 1).alias("before_hop"), first.alias("from_by"), F.col("__to").alias("to_from"), words.alias("description"))


def display(hops: DataFrame, gateways: DataFrame | None = None, node: str = "node_id") -> DataFrame:
    """Numbered hops as shown: names, deltas, zones, annotations, and gateway findings after the hop they belong to.

    gateways: node, type, label, data (a map; a Forefront finding names the connecting address as cip).
    """
    rows = with_zone_changes(with_deltas(hops, node), node)
    self_loop = F.rtrim(F.lower(from_display()), F.lit(".")) == F.rtrim(F.lower(by_display()), F.lit("."))
    notes = F.array_compact(F.array(F.when(is_internal(), F.lit("internal")), F.when(self_loop, F.lit("self-loop"))))
    kind = F.coalesce("server_type", F.lit(""))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    zone = F.coalesce("tz_offset", F.lit(""))
    edge = F.min(F.when(F.lower("by_hostname").rlike(r"mail\.protection\.outlook\.com|prod\.outlook\.com"), F.col("hop_no"))).over(Window.partitionBy(node))
    out = rows.select(
        node, F.col("hop_no").alias("hop"), by_display().alias("by_hostname"), F.coalesce("by_ip", F.lit("")).alias("by_ip"),
        from_display().alias("from_name"),
        F.coalesce(F.nullif(F.col("from_ip"), F.lit("")), F.nullif(F.col("from_ipv6"), F.lit("")), F.lit("")).alias("from_ip"),
        F.col("from_ip").alias("__from_ip"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("protocol", "tls", "cipher")],
        F.when(kind == "unknown", "").otherwise(kind).alias("server_type"),
        F.when(stamp.isNull(), "").otherwise(F.rtrim(F.concat(stamp, F.lit(" "), zone))).alias("timestamp"),
        "delta_seconds", "delta_display", zone.alias("tz_offset"), "tz_changed", "prev_tz",
        (~has_tls() & (from_display() != "?") & ~self_loop).alias("no_tls"), is_internal().alias("is_internal"),
        notes.alias("annotations"), F.coalesce("authenticated_sender", F.lit("")).alias("authenticated_sender"),
        edge.alias("__edge"), F.max("hop_no").over(Window.partitionBy(node)).alias("__last"),
    )
    none = F.array().cast("array<struct<type:string,label:string>>")
    if gateways is None:
        return out.withColumn("inferred_after", none).withColumn("footer", none).drop("__edge", "__from_ip", "__last")
    found = gateways.select(F.col(node).alias("__n"), "type", "label", F.col("data")["cip"].alias("cip"))
    item = F.struct("type", "label")
    cips = out.join(found.where("type = 'forefront'"), (F.col(node) == F.col("__n")) & (F.col("__from_ip") == F.col("cip")))
    first = cips.groupBy(node, "type", "label").agg(F.min("hop").alias("hop"))
    by_node = found.groupBy("__n").agg(
        F.sort_array(F.collect_list(F.when(F.col("type") == "ironport", item))).alias("ironport"),
        F.sort_array(F.collect_list(F.when(F.col("type").isin("mua", "originating_ip", "exchange_auth"), item))).alias("feet"),
        F.sort_array(F.collect_list(F.when(~F.col("type").isin("ironport", "forefront", "mua", "originating_ip", "exchange_auth"), item))).alias("rest"),
    )
    placed = first.groupBy(F.col(node).alias("__m"), F.col("hop").alias("__hop")).agg(F.sort_array(F.collect_list(item)).alias("forefront"))
    joined = out.join(by_node, F.col(node) == F.col("__n"), "left").join(placed, (F.col(node) == F.col("__m")) & (F.col("hop") == F.col("__hop")), "left")
    last = F.col("hop") == F.col("__last")
    after = F.concat(
        F.when(F.col("hop") == F.col("__edge") - 1, F.coalesce("ironport", none)).otherwise(none),
        F.coalesce("forefront", none),
        F.when(last, F.coalesce("rest", none)).otherwise(none),
    )
    return joined.withColumn("inferred_after", after).withColumn("footer", F.when(last, F.coalesce("feet", none)).otherwise(none)).drop(
        "__edge", "__from_ip", "__last", "__n", "__m", "__hop", "ironport", "forefront", "feet", "rest"
    )


def route_text(hops: DataFrame, node: str = "node_id") -> DataFrame:
    """(node, route): the hops, oldest first, one line each."""
    address = lambda shown, *ips: F.coalesce(*[F.when((F.coalesce(ip, F.lit("")) != "") & (F.col(ip) != shown), F.concat(F.lit(" ["), F.col(ip), F.lit("]"))) for ip in ips], F.lit(""))
    some = lambda c, before, after="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), F.col(c), F.lit(after))).otherwise("")
    later = seconds_between(F.col("ts"), F.lead("ts").over(_along(node)))
    security = F.when(F.coalesce("tls", F.lit("")) != "", some("tls", " TLS:")).otherwise(some("cipher", " cipher:"))
    zone = F.coalesce(F.regexp_replace(F.nullif(F.col("tz_offset"), F.lit("")), r"(\d\d)(\d\d)$", "$1:$2"), F.lit(""))
    line = F.concat(
        F.lit("  "), F.col("hop_no").cast("string"), F.lit(". "), from_display(), address(from_display(), "from_ip", "from_ipv6"),
        F.lit(" -> "), by_display(), address(by_display(), "by_ip"), some("protocol", " (", ")"), security,
        F.when(F.coalesce("server_type", F.lit("unknown")) == "unknown", "").otherwise(some("server_type", " [", "]")),
        some("authenticated_sender", " AUTH:"), F.when(is_internal(), F.lit(" (internal)")).otherwise(""),
        F.when(later.isNotNull(), F.concat(F.lit("  ("), delta_text(later), F.lit(")"))).otherwise(""),
        F.when(F.col("ts").isNotNull(), F.concat(F.lit("  ["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), zone, F.lit("]"))).otherwise(""),
    )
    lines = hops.select(node, "hop_no", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("hop_no", "line")))
    return lines.groupBy(node).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("route"))


def origin(hops: DataFrame, node: str = "node_id") -> DataFrame:
    """(node, origin_ip, origin_name, tls): the oldest hop with an outside address, else the oldest; how much is encrypted."""
    ip = F.coalesce(F.nullif(F.col("from_ip"), F.lit("")), F.nullif(F.col("from_ipv6"), F.lit("")))
    rank = F.struct((ip.isNull() | is_internal()).alias("inside"), F.col("hop_no"))
    return hops.groupBy(node).agg(
        F.min_by(F.struct(ip.alias("ip"), from_display().alias("name")), rank).alias("o"),
        F.when(F.every(has_tls()), "TLS").when(F.some(has_tls()), "partial TLS").otherwise("no TLS").alias("tls"),
    ).select(node, F.col("o.ip").alias("origin_ip"), F.col("o.name").alias("origin_name"), "tls")


def without_tls(hops: DataFrame, node: str = "node_id", n: int = 5) -> DataFrame:
    """Hops in the clear between two known, different hosts; the first n of each message."""
    clear = hops.where(~has_tls() & (from_display() != "?") & (from_display() != by_display()))
    return clear.withColumn("place", F.row_number().over(Window.partitionBy(node).orderBy("hop_no"))).where(F.col("place") <= n)
