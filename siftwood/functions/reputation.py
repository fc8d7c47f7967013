"""Verdicts of a reputation service on hashes, domains and addresses: asked online, or joined from a table.

Nothing is asked unless the network policy is online and there is a key; each distinct value is asked once a run.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from urllib import error as url_error
from urllib import parse, request

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.config import Flags
from siftwood.operators.reports import make_report
from siftwood.runtime import ship

# Where each kind of value is asked for, and shown.
KINDS = {"file": ("files", "file"), "domain": ("domains", "domain"), "ip": ("ip_addresses", "ip-address")}
SERVICE, PAGES = "https://www.virustotal.com/api/v3", "https://www.virustotal.com/gui"
COUNTS = ("malicious", "suspicious", "harmless", "undetected", "timeout")
VERDICT = "kind string, value string, " + ", ".join(f"{c} int" for c in COUNTS) + ", reputation int, last_analysis_date long, as_owner string, country string, permalink string"
_ARROW = pa.schema([("kind", pa.string()), ("value", pa.string()), *((c, pa.int32()) for c in COUNTS), ("reputation", pa.int32()), ("last_analysis_date", pa.int64()), ("as_owner", pa.string()), ("country", pa.string()), ("permalink", pa.string())])


def api_key(flags: Flags) -> str | None:
    return flags.vt_api_key or os.environ.get("VT_API_KEY") or os.environ.get("VIRUSTOTAL_API_KEY")


def allowed(flags: Flags) -> bool:
    return flags.network_policy == "online" and bool(api_key(flags))


def address(kind: str, value: str) -> str:
    return f"{SERVICE}/{KINDS[kind][0]}/{parse.quote(value, safe='')}"


def verdict(kind: str, value: str, answer: bytes | str) -> dict | None:
    """One answer as a row; None where it is no answer."""
    try:
        attributes = json.loads(answer).get("data", {}).get("attributes", {})
    except (ValueError, AttributeError):
        return None
    stats = attributes.get("last_analysis_stats") or {}
    row = {"kind": kind, "value": value} | {c: int(stats.get(c) or 0) for c in COUNTS}
    row |= {k: attributes.get(k) for k in ("reputation", "last_analysis_date", "as_owner", "country")}
    return row | {"permalink": f"{PAGES}/{KINDS[kind][1]}/{value}"}


def fetch(url: str, key: str, seconds: float = 10) -> bytes | None:
    try:
        with request.urlopen(request.Request(url, headers={"x-apikey": key, "accept": "application/json"}), timeout=seconds) as answer:
            return answer.read()
    except (url_error.URLError, OSError, ValueError):
        return None


def lookups(values: DataFrame, flags: Flags, ask: Callable[[str, str], bytes | None] = fetch) -> DataFrame:
    """Verdicts on the distinct (kind, value) rows, without those that have none; nothing where asking is not allowed."""
    spark = values.sparkSession
    if not allowed(flags):
        return spark.createDataFrame([], VERDICT)
    ship(spark)
    key = api_key(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                answer = ask(address(kind, value), key) if kind in KINDS and value else None
                row = verdict(kind, value, answer) if answer else None
                if row:
                    rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return values.select("kind", "value").distinct().mapInArrow(run, VERDICT)


def budgeted(iocs: DataFrame, budget: int = 10) -> DataFrame:
    """(kind, value): the domains, then addresses that are worth asking for, so many of each root."""
    from pyspark.sql import Window

    rank = F.when(F.col("kind") == "domains", 0).when(F.col("kind") == "ipv4", 1).otherwise(2)
    order = Window.partitionBy("root_id").orderBy(rank, "path", "pos", "value")
    some = iocs.where(F.col("kind").isin("domains", "ipv4", "ipv6")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= budget)
    return some.select(F.when(F.col("kind") == "domains", "domain").otherwise("ip").alias("kind"), "value").distinct()


def verdict_reports(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(root_id, node_id and a report's fields): what is known of each node's content; hits make it grave."""
    known = verdicts.where("kind = 'file'").drop("kind").dropDuplicates(["value"])
    told = nodes.select("root_id", "node_id", "sha256").join(known, F.col("sha256") == F.col("value"))
    n = lambda c: F.col(c).cast("string")
    hits = F.coalesce("malicious", F.lit(0)) + F.coalesce("suspicious", F.lit(0))
    words = F.concat(F.lit("VirusTotal: malicious="), n("malicious"), F.lit(", suspicious="), n("suspicious"), F.lit(", harmless="), n("harmless"), F.lit(", undetected="), n("undetected"))
    report = make_report(
        "virustotal", words, short=F.concat(F.lit("VT "), hits.cast("string"), F.lit(" hit(s)")), label="virustotal",
        severity=F.when(hits > 0, 1).otherwise(4), order=29, data=F.to_json(F.struct(*[c for c in known.columns if c != "value"], F.col("sha256"))),
    )
    return told.select("root_id", "node_id", report.alias("r")).select("root_id", "node_id", "r.*")
