"""The queries over the shared tables, each with its SQL where SQL expresses it.

Documents stand for text nodes, pages for HTML nodes, events for relay hops of their user (the larger id is the older
header), the region-to-lineitem keys for a tree of nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions import content, iocs, scripts, text
from siftwood.operators import hops, reports, rules
from siftwood.runtime import ship
from siftwood.schema import IOC_KINDS, severity_name

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_list(words) -> str:
    return ", ".join(quoted(w) for w in words)


# --- indicators ---------------------------------------------------------------------------------------------------

_RAW = " UNION ALL ".join(
    f"SELECT doc_id, source, '{k}' AS kind, unnest(m) AS value, generate_subscripts(m, 1) AS place FROM "
    f"(SELECT doc_id, source, regexp_extract_all(text, {quoted(p)}{g}) AS m FROM documents)"
    for k, p, g in (
        ("ipv4", iocs.IPV4, ""), ("ipv6", iocs.IPV6, ""), ("urls", iocs.URL, ""), ("emails", iocs.EMAIL, ""),
        ("domains", iocs.DOMAIN, ""), ("md5", iocs.MD5, ""), ("sha1", iocs.SHA1, ""), ("sha256", iocs.SHA256, ""),
        ("passwords", iocs.PASSWORD, ", 1"),
    )
)
_IP = "(split_part(value,'.',1)::BIGINT*16777216+split_part(value,'.',2)::BIGINT*65536+split_part(value,'.',3)::BIGINT*256+split_part(value,'.',4)::BIGINT)"
_HOST = "lower(split_part(split_part(split_part(split_part(value,'://',2),'/',1),':',1),'?',1))"
IOCS_SQL = f"""
WITH raw AS ({_RAW}),
cleaned AS (SELECT doc_id, source, kind, place, CASE WHEN kind='urls' THEN regexp_replace(value, {quoted(iocs.URL_TAIL)}, '') ELSE value END AS value FROM raw),
kept AS (
  SELECT * FROM cleaned WHERE CASE kind
    WHEN 'ipv4' THEN NOT ends_with(value, '.0.0') AND NOT ({_IP} BETWEEN 167772160 AND 184549375
      OR {_IP} BETWEEN 2886729728 AND 2887778303 OR {_IP} BETWEEN 3232235520 AND 3232301055
      OR {_IP} BETWEEN 2130706432 AND 2147483647 OR {_IP} BETWEEN 2851995648 AND 2852061183)
    WHEN 'urls' THEN length(value) > 10
    WHEN 'passwords' THEN length(value) >= 4 AND lower(value) NOT IN ({sql_list(iocs.NOT_PASSWORDS)})
    ELSE true END),
seen AS (SELECT doc_id, lower(split_part(value,'@',2)) AS d FROM kept WHERE kind='emails' UNION SELECT doc_id, {_HOST} FROM kept WHERE kind='urls'),
told AS (
  SELECT k.* FROM kept k WHERE kind <> 'domains' OR (
    lower(value) NOT IN ({sql_list(iocs.SKIPPED_DOMAINS)})
    AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.doc_id = k.doc_id AND s.d = lower(k.value))
    AND NOT (length(value) - length(replace(value,'.','')) = 1 AND length(split_part(value,'.',1)) <= 3))),
firsts AS (SELECT doc_id, source, kind, arg_min(value, place) AS value, min(place) AS place FROM told GROUP BY doc_id, source, kind, lower(value)),
iocs AS (SELECT doc_id, source, kind, value, CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY place) - 1 AS INTEGER) AS pos FROM firsts)
"""


def _iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iocs.long_indicators(t(spark, sf_dir, "documents"), F.col("text"), "doc_id", "source")


@query(IOCS_SQL + f"SELECT k.kind, count(i.kind) AS n FROM (SELECT unnest([{sql_list(IOC_KINDS)}]) AS kind) k LEFT JOIN iocs i USING (kind) GROUP BY k.kind")
def ioc_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: indicators of all documents, counted by kind; kinds that do not occur count 0."""
    found = t(spark, sf_dir, "documents").select(iocs.indicators(F.col("text")).alias("i"))
    sums = found.agg(*[F.sum(F.size(f"i.{k}")).cast("long").alias(k) for k in IOC_KINDS])
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(k, F.lit(0)).alias("n")) for k in IOC_KINDS])
    return sums.select(F.explode(each).alias("x")).select("x.kind", "x.n")


@query(IOCS_SQL + "SELECT doc_id, kind, value, pos FROM iocs")
def ioc_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iocs(spark, sf_dir).drop("source")


@query(IOCS_SQL + "SELECT doc_id, value FROM iocs WHERE kind='ipv4'")
def ioc_public_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t(spark, sf_dir, "documents").select("doc_id", iocs.indicators(F.col("text")).alias("i"))
    return found.select("doc_id", F.explode("i.ipv4").alias("value"))


#: Texts with names of hosts behind them: one of a mail address, one of a URL, one that is skipped, one too short, two to keep.
_HOSTED_SQL = """SELECT doc_id, source, text || ' write to a@mail' || doc_id % 7 || '.example.org, see http://www.shop' || doc_id % 5 || '.example.net/x, mail' || doc_id % 7 ||
'.example.org www.shop' || doc_id % 5 || '.example.net schemas.microsoft.com ab.com host' || doc_id % 11 || '.example.com HOST' || doc_id % 11 || '.example.com files.corp.example.de' AS text FROM documents"""


def _hosted() -> F.Column:
    k = lambda n: (F.col("doc_id") % n).cast("string")
    return F.concat(
        "text", F.lit(" write to a@mail"), k(7), F.lit(".example.org, see http://www.shop"), k(5), F.lit(".example.net/x, mail"), k(7), F.lit(".example.org www.shop"), k(5),
        F.lit(".example.net schemas.microsoft.com ab.com host"), k(11), F.lit(".example.com HOST"), k(11), F.lit(".example.com files.corp.example.de"),
    )


@query(IOCS_SQL.replace("FROM documents)", "FROM hosted)").replace("WITH raw AS", f"WITH hosted AS ({_HOSTED_SQL}), raw AS") + "SELECT doc_id, value FROM iocs WHERE kind='domains'")
def ioc_domains_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t(spark, sf_dir, "documents").select("doc_id", iocs.indicators(_hosted()).alias("i"))
    return found.select("doc_id", F.explode("i.domains").alias("value"))


@query(
    IOCS_SQL
    + """SELECT doc_id, kind, CASE WHEN kind IN ('ipv4','ipv6','domains') THEN replace(value,'.','[.]')
    WHEN kind='urls' THEN replace(replace(replace(value,'http://','hxxp://'),'https://','hxxps://'),'ftp://','fxp://')
    WHEN kind='emails' THEN replace(value,'@','[@]') ELSE value END AS value FROM iocs"""
)
def ioc_defanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iocs(spark, sf_dir).select("doc_id", "kind", iocs.defanged(F.col("kind"), F.col("value")).alias("value"))


@query(IOCS_SQL + "SELECT source, kind, arg_min(value, {'d': doc_id, 'p': pos}) AS value, min(doc_id) AS first_doc FROM iocs GROUP BY source, kind, lower(value)")
def ioc_merged_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = iocs.merged(_iocs(spark, sf_dir), "source", order=["doc_id", "pos"])
    return found.select("source", "kind", "value", F.col("first.doc_id").alias("first_doc"))


@query(
    IOCS_SQL
    + """, v AS (SELECT value, CAST(length(value) % 7 AS INTEGER) AS malicious FROM iocs WHERE kind IN ('domains','ipv4','ipv6') GROUP BY value),
r AS (SELECT source, kind, value, malicious, row_number() OVER (PARTITION BY source ORDER BY CASE kind WHEN 'domains' THEN 0 WHEN 'ipv4' THEN 1 ELSE 2 END, pos, value, doc_id) AS lookup
 FROM iocs JOIN v USING (value) WHERE kind IN ('domains','ipv4','ipv6'))
SELECT source, count(*) AS lookups, CAST(sum(malicious) AS BIGINT) AS malicious FROM r WHERE lookup <= 10 GROUP BY source"""
)
def ioc_enrichment_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten look-ups for each source; verdicts are made up from the value's length."""
    found = _iocs(spark, sf_dir)
    verdicts = found.where(F.col("kind").isin("domains", "ipv4", "ipv6")).groupBy("value").agg(F.first(F.length("value") % 7).alias("malicious"))
    known = iocs.enriched(found.withColumn("pos", F.col("pos")), verdicts, "source")
    return known.groupBy("source").agg(F.count("*").alias("lookups"), F.sum("malicious").cast("long").alias("malicious"))


@query(
    IOCS_SQL
    + """SELECT d.doc_id, CASE WHEN count(i.doc_id) FILTER (WHERE i.kind IN ('urls','ipv4')) > 0 THEN 2 ELSE 4 END AS severity, count(i.doc_id) AS total
FROM documents d JOIN iocs i USING (doc_id) GROUP BY d.doc_id"""
)
def ioc_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report that a text node gets where it holds indicators."""
    found = t(spark, sf_dir, "documents").select("doc_id", iocs.indicators(F.col("text")).alias("i"))
    return found.select("doc_id", iocs.severity(F.col("i")).alias("severity"), iocs.total(F.col("i")).cast("long").alias("total")).where("total > 0")


# --- content ------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return t(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), *[h.alias(k) for k, h in content.hashes(raw).items()])


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS occurrences FROM documents GROUP BY sha256(text)")
def first_seen_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id", "source")
    return rules.first_seen(nodes, "sha256", "doc_id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents b JOIN labels USING (doc_id) WHERE md5(b.text) = md5(d.text))")
def unseen_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content no labelled document has."""
    docs = t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"))
    seen = docs.join(t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select("md5")
    return rules.unseen(docs, seen, "md5").select("doc_id")


_ENTROPY_SQL = """
WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents),
c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY doc_id, byte),
s AS (SELECT doc_id, sum(n) AS size FROM c GROUP BY doc_id),
e AS (SELECT doc_id, any_value(size) AS size, -sum(n/size*log2(n/size)) AS entropy FROM c JOIN s USING (doc_id) GROUP BY doc_id)
"""


@query(
    _ENTROPY_SQL
    + """SELECT doc_id, CAST(size AS BIGINT) AS size, round(entropy, 6) AS entropy,
CASE WHEN size >= 256 AND entropy >= 7.6 THEN 'MEDIUM' WHEN size >= 128 AND entropy >= 7.2 THEN 'LOW' ELSE 'INFO' END AS severity FROM e"""
)
def entropy_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), content.entropy(F.col("text").cast("binary")).alias("entropy"))
    level = content.entropy_severity(F.col("entropy"), F.col("size"))
    return docs.select("doc_id", "size", F.round("entropy", 6).alias("entropy"), severity_name(level).alias("severity"))


@query(
    """
WITH d AS (SELECT doc_id, encode(text) AS raw, octet_length(encode(text)) AS size FROM documents WHERE octet_length(encode(text)) >= 1024),
p AS (SELECT doc_id, hex(raw) AS h, least(64, size // 1024) AS n, size // least(64, size // 1024) AS block FROM d),
k AS (SELECT doc_id, h, block, unnest(range(n)) AS i FROM p),
b AS (SELECT doc_id, i, block, unnest(regexp_extract_all(substr(h, 2*i*block+1, 2*block), '..')) AS byte FROM k),
c AS (SELECT doc_id, i, block, byte, count(*) AS n FROM b GROUP BY ALL)
SELECT doc_id, CAST(i AS INTEGER) AS block, round(-sum(n/block*log2(n/block)), 6) AS entropy FROM c GROUP BY doc_id, i
"""
)
def block_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", content.block_entropy(F.col("text").cast("binary")).alias("blocks"))
    return docs.select("doc_id", F.posexplode("blocks").alias("block", "entropy")).select("doc_id", "block", F.round("entropy", 6).alias("entropy"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(html, '(?i)^\\s*BEGIN:VCALENDAR') THEN 'text/calendar'
WHEN regexp_matches(html, '(?i)^\\s*(<!doctype\\s+html|<html[\\s>])') THEN 'text/html' WHEN regexp_matches(html, '(?i)^\\s*<\\?xml') THEN 'text/xml' ELSE 'text/plain' END AS mime FROM pages"""
)
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", content.detected(F.col("html").cast("binary"), F.lit(None).cast("string"))["mime"].alias("mime"))


_PARTS = "SELECT p_partkey, replace(p_name, ' ', '.') || CASE p_size % 6 WHEN 0 THEN '.pdf.exe' WHEN 1 THEN '.js' WHEN 2 THEN '.txt' WHEN 3 THEN ': a*b?.doc' WHEN 4 THEN '.tar.gz' ELSE '' END AS filename FROM part"
_CRIT, _HIGH, _DOCS = (sql_list(x) for x in (content.CRITICAL_EXTENSIONS, content.HIGH_EXTENSIONS, content.DOCUMENT_EXTENSIONS))


@query(
    f"""WITH f AS ({_PARTS}), x AS (SELECT *, lower(regexp_extract(filename, '[^.]\\.([^./\\\\]*)$', 1)) AS ext,
lower(regexp_extract(filename, '\\.([^.]*)\\.([^.]*)$', 2)) AS l, lower(regexp_extract(filename, '\\.([^.]*)\\.([^.]*)$', 1)) AS b FROM f)
SELECT p_partkey, regexp_replace(regexp_replace(filename, '[ <>|:!&*?/]', '_', 'g'), '_+', '_', 'g') AS safe_name,
CASE WHEN ext IN ({_CRIT}) THEN 0 WHEN ext IN ({_HIGH}) THEN 1 END AS severity,
coalesce(l IN ({_CRIT},{_HIGH},{_DOCS}) AND b IN ({_CRIT},{_HIGH},{_DOCS}), false) AS double_extension FROM x"""
)
def dangerous_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of part names and suffixes."""
    size = F.col("p_size") % 6
    suffix = F.when(size == 0, ".pdf.exe").when(size == 1, ".js").when(size == 2, ".txt").when(size == 3, ": a*b?.doc").when(size == 4, ".tar.gz").otherwise("")
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), suffix)
    return t(spark, sf_dir, "part").select(
        "p_partkey", content.sanitized_filename(name).alias("safe_name"), content.dangerous_extension(name).alias("severity"), content.double_extension(name).alias("double_extension")
    )


# --- reports and the tree -----------------------------------------------------------------------------------------

_TREE_SQL = """
WITH own AS (
 SELECT 'l'||l_orderkey||'-'||l_linenumber AS node_id, 'o'||l_orderkey AS parent, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 3 ELSE 4 END AS severity FROM lineitem
 UNION ALL SELECT 'o'||o_orderkey, 'c'||o_custkey, CAST(substr(o_orderpriority,1,1) AS INTEGER) - 1 FROM orders
 UNION ALL SELECT 'c'||c_custkey, 'n'||c_nationkey, CASE WHEN c_acctbal < 0 THEN 2 ELSE 4 END FROM customer
 UNION ALL SELECT 'n'||n_nationkey, 'r'||n_regionkey, 4 FROM nation
 UNION ALL SELECT 'r'||r_regionkey, NULL, 4 FROM region)
"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with ancestors, own severities) of the five levels."""
    s = lambda c: F.col(c).cast("string")
    nation = t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    r, n, c, o = (F.concat(F.lit(x), s(k)) for x, k in (("r", "n_regionkey"), ("n", "n_nationkey"), ("c", "c_custkey"), ("o", "o_orderkey")))
    line = F.concat(F.lit("l"), s("l_orderkey"), F.lit("-"), s("l_linenumber"))
    nations = nation.select("n_nationkey", F.array(r, n).alias("a"))
    customers = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", F.concat("a", F.array(c)).alias("a"))
    ordered = orders.join(customers.select("c_custkey", "a"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", F.concat("a", F.array(o)).alias("a"))
    leaves = lines.join(ordered.select("o_orderkey", "a"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_returnflag", F.concat("a", F.array(line)).alias("a"))
    regions = t(spark, sf_dir, "region").select(F.array(F.concat(F.lit("r"), s("r_regionkey"))).alias("a"))
    flag = F.col("l_returnflag")
    parts = [
        leaves.select("a", F.when(flag == "R", 1).when(flag == "A", 3).otherwise(4).alias("severity")),
        ordered.select("a", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("severity")),
        customers.select("a", F.when(F.col("c_acctbal") < 0, 2).otherwise(4).alias("severity")),
        nations.select("a", F.lit(4).alias("severity")),
        regions.select("a", F.lit(4).alias("severity")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select(F.element_at("a", -1).alias("node_id"), F.col("a").alias("ancestors"), "severity")


@query(
    _TREE_SQL
    + """, o AS (SELECT p.node_id, p.parent, least(any_value(p.severity), coalesce(min(k.severity), 4)) AS severity FROM own p LEFT JOIN own k ON k.parent = p.node_id WHERE p.node_id LIKE 'o%' GROUP BY p.node_id, p.parent),
c AS (SELECT p.node_id, p.parent, least(any_value(p.severity), coalesce(min(k.severity), 4)) AS severity FROM own p LEFT JOIN o k ON k.parent = p.node_id WHERE p.node_id LIKE 'c%' GROUP BY p.node_id, p.parent),
n AS (SELECT p.node_id, p.parent, least(any_value(p.severity), coalesce(min(k.severity), 4)) AS severity FROM own p LEFT JOIN c k ON k.parent = p.node_id WHERE p.node_id LIKE 'n%' GROUP BY p.node_id, p.parent),
r AS (SELECT p.node_id, p.parent, least(any_value(p.severity), coalesce(min(k.severity), 4)) AS severity FROM own p LEFT JOIN n k ON k.parent = p.node_id WHERE p.node_id LIKE 'r%' GROUP BY p.node_id, p.parent)
SELECT node_id, severity FROM r UNION ALL SELECT node_id, severity FROM n UNION ALL SELECT node_id, severity FROM c UNION ALL SELECT node_id, severity FROM o
UNION ALL SELECT node_id, min(severity) FROM own WHERE node_id LIKE 'l%' GROUP BY node_id"""
)
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst severity of every node of the tree with all that lies below it."""
    every = _tree(spark, sf_dir)
    each = every.select(F.explode("ancestors").alias("node_id"), "severity")
    return each.groupBy("node_id").agg(F.min("severity").alias("severity"))


@query(_TREE_SQL + "SELECT severity, count(*) AS nodes, severity <= 2 AS finding FROM own GROUP BY severity")
def own_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("nodes")).withColumn("finding", F.col("severity") <= 2)


_REPORTS_SQL = """
WITH reports AS (SELECT user_id, event_id AS seq, event_type AS label, CAST(event_id % 5 AS INTEGER) AS severity, CAST(event_id % 3 AS INTEGER) AS verbosity,
 CAST(event_id % 7 AS INTEGER) AS ord, repeat(event_type || ' ', 400) AS text, CASE WHEN event_type='error' THEN 'view' END AS replaces FROM events),
seen AS (SELECT * FROM reports WHERE verbosity <= 1),
shown AS (SELECT * REPLACE (CASE WHEN length(text) > 2048 THEN left(text, 2048) || '…' ELSE text END AS text) FROM seen s
 WHERE NOT EXISTS (SELECT 1 FROM seen r WHERE r.user_id = s.user_id AND r.replaces = s.label))
"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of events: a user is a node, errors replace views."""
    n = F.col("event_id")
    return t(spark, sf_dir, "events").select(
        "user_id", n.alias("seq"), F.col("event_type").alias("label"), (n % 5).cast("int").alias("severity"), (n % 3).cast("int").alias("verbosity"),
        (n % 7).cast("int").alias("ord"), F.repeat(F.concat("event_type", F.lit(" ")), F.lit(400)).alias("text"),
        F.when(F.col("event_type") == "error", "view").alias("replaces"),
    )


@query(_REPORTS_SQL + "SELECT user_id, seq, label, severity, length(text) AS shown_length FROM shown")
def report_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shown(_reports(spark, sf_dir), 1, "user_id").select("user_id", "seq", "label", "severity", F.length("text").cast("long").alias("shown_length"))


@query(_REPORTS_SQL + "SELECT * FROM (SELECT user_id, seq, severity, ord, row_number() OVER (PARTITION BY user_id ORDER BY severity, ord, seq) AS place FROM reports) WHERE place <= 3")
def report_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top(_reports(spark, sf_dir), 3, "user_id").select("user_id", "seq", "severity", "ord", "place")


@query(
    """SELECT doc_id, severity FROM (SELECT d.doc_id, coalesce(min(CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 0 THEN 2 ELSE 4 END), 4) AS severity
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id)"""
)
def worst_own_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 2).otherwise(4).alias("severity"))
    return reports.worst_own(t(spark, sf_dir, "documents"), found, "doc_id")


@query(
    """WITH r AS (SELECT user_id, event_id, event_type AS report_key, value > 20 AS is_primary, CASE WHEN event_id % 11 = 0 THEN 'error' ELSE event_type END AS label, CAST(event_id % 4 AS INTEGER) AS specificity FROM events)
SELECT user_id, report_key, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, report_key ORDER BY is_primary DESC, specificity, event_id) AS n FROM r WHERE is_primary OR label <> 'error') WHERE n = 1"""
)
def contributor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = t(spark, sf_dir, "events").select(
        "user_id", n.alias("seq"), F.col("event_type").alias("report_key"), (F.col("value") > 20).alias("is_primary"),
        F.when(n % 11 == 0, "error").otherwise(F.col("event_type")).alias("label"), (n % 4).cast("int").alias("specificity"),
    )
    return reports.merge_contributors(rows, "user_id").select("user_id", "report_key", "seq")


@query(
    """SELECT doc_id, arg_max(analyzer, spec * 100 + reg) AS analyzer FROM (
SELECT doc_id, 'PlainTextAnalyzer' AS analyzer, 5 AS spec, 2 AS reg FROM documents
UNION ALL SELECT doc_id, 'HTMLAnalyzer', 15, 5 FROM documents WHERE text LIKE '%|%'
UNION ALL SELECT doc_id, 'EmailAnalyzer', 20, 1 FROM documents WHERE lang = 'de'
UNION ALL SELECT doc_id, 'MboxAnalyzer', 20, 8 FROM documents WHERE source = 'src1') GROUP BY doc_id"""
)
def analyzer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents")
    row = lambda rows, name, spec, reg: rows.select("doc_id", F.lit(name).alias("analyzer"), F.lit(spec).alias("specificity"), F.lit(reg).alias("registered"))
    every = row(docs, "PlainTextAnalyzer", 5, 2).union(row(docs.where(F.contains("text", F.lit("|"))), "HTMLAnalyzer", 15, 5))
    every = every.union(row(docs.where("lang = 'de'"), "EmailAnalyzer", 20, 1)).union(row(docs.where("source = 'src1'"), "MboxAnalyzer", 20, 8))
    return rules.best_analyzer(every, "doc_id")


@query("SELECT user_id, event_type AS mime, props LIKE '%1%' AS flag, list_sort(list(DISTINCT CAST(event_id % 3 AS VARCHAR))) AS providers FROM events GROUP BY ALL")
def provider_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("mime"), F.contains("props", F.lit("1")).alias("description"), (F.col("event_id") % 3).cast("string").alias("provider"))
    return reports.providers_by_answer(rows, "user_id").withColumnRenamed("description", "flag")


# --- hops ---------------------------------------------------------------------------------------------------------

_HOPS_SQL = """
WITH h AS (SELECT user_id AS node_id, event_id AS pos, ts, event_type || '.example.net' AS from_name, '' AS from_hostname,
 CASE WHEN event_id % 5 = 0 THEN '10.0.0.1' WHEN event_id % 5 = 1 THEN '' ELSE '93.184.216.' || event_id % 200 END AS from_ip, '' AS from_ipv6,
 CASE event_id % 3 WHEN 0 THEN 'view.example.net' WHEN 1 THEN 'click.example.org' ELSE '' END AS by_hostname, CASE WHEN event_id % 2 = 0 THEN '93.184.216.7' ELSE '' END AS by_ip,
 CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '+0100' WHEN 2 THEN '+0200' ELSE '+0000' END AS tz_offset, CASE WHEN value > 20 THEN 'TLSv1.3' ELSE '' END AS tls FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY pos DESC) AS hop_no FROM h),
l AS (SELECT *, lag(ts) OVER w AS before, lead(ts) OVER w AS after, lead(from_name) OVER w AS next_name, lead(from_hostname) OVER w AS next_host, lead(from_ip) OVER w AS next_ip,
 last_value(nullif(tz_offset,'') IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY hop_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known_tz FROM o WINDOW w AS (PARTITION BY node_id ORDER BY hop_no))
"""


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    s = lambda c: c.cast("string")
    rows = t(spark, sf_dir, "events").select(
        F.col("user_id").alias("node_id"), n.alias("pos"), "ts", F.concat("event_type", F.lit(".example.net")).alias("from_name"),
        F.lit("").alias("from_hostname"),
        F.when(n % 5 == 0, "10.0.0.1").when(n % 5 == 1, "").otherwise(F.concat(F.lit("93.184.216."), s(n % 200))).alias("from_ip"),
        F.lit("").alias("from_ipv6"),
        F.when(n % 3 == 0, "view.example.net").when(n % 3 == 1, "click.example.org").otherwise("").alias("by_hostname"),
        F.when(n % 2 == 0, "93.184.216.7").otherwise("").alias("by_ip"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, "+0100").when(n % 4 == 2, "+0200").otherwise("+0000").alias("tz_offset"),
        F.when(F.col("value") > 20, "TLSv1.3").otherwise("").alias("tls"),
        *[F.lit("").alias(c) for c in ("cipher", "protocol", "server_type", "authenticated_sender")],
    )
    return hops.numbered(rows)


_SECONDS = "CAST(trunc((epoch_us({b}) - epoch_us({a})) / 1000000.0) AS BIGINT)"
_DELTA = _SECONDS.format(a="before", b="ts")


@query(
    _HOPS_SQL
    + f""", d AS (SELECT node_id, hop_no, {_DELTA} AS delta_seconds FROM l)
SELECT node_id, CAST(hop_no AS INTEGER) AS hop_no, delta_seconds, CASE WHEN delta_seconds IS NULL THEN '' WHEN delta_seconds < 0 THEN delta_seconds || 's SKEW' WHEN delta_seconds < 60 THEN delta_seconds || 's'
WHEN delta_seconds < 3600 THEN delta_seconds // 60 || 'm' || delta_seconds % 60 || 's' ELSE delta_seconds // 3600 || 'h' || delta_seconds % 3600 // 60 || 'm' END AS delta_display FROM d"""
)
def hop_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops.with_deltas(_hops(spark, sf_dir)).select("node_id", "hop_no", "delta_seconds", "delta_display")


@query(
    _HOPS_SQL
    + f""", d AS (SELECT node_id, hop_no, {_SECONDS.format(a="ts", b="after")} AS delta_seconds FROM l)
SELECT node_id, CAST(hop_no AS INTEGER) AS hop, CASE WHEN delta_seconds < -300 THEN 'possible_forgery' WHEN delta_seconds < -5 THEN 'clock_skew' ELSE 'long_delay' END AS type, delta_seconds
FROM d WHERE delta_seconds < -5 OR delta_seconds > 86400"""
)
def hop_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops.latency_anomalies(_hops(spark, sf_dir)).drop("description")


@query(
    _HOPS_SQL
    + f""", d AS (SELECT node_id, {_SECONDS.format(a="ts", b="after")} AS s FROM l)
SELECT node_id, min(s) AS worst_delta, CASE WHEN min(s) < -300 THEN 2 ELSE 3 END AS severity FROM d WHERE s < -5 OR s > 86400 GROUP BY node_id"""
)
def hop_worst_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops.worst_latency(hops.latency_anomalies(_hops(spark, sf_dir)))


@query(
    _HOPS_SQL
    + """SELECT node_id, CAST(hop_no AS INTEGER) AS hop_no, tz_offset, coalesce(known_tz <> tz_offset AND tz_offset <> '', false) AS tz_changed,
CASE WHEN coalesce(known_tz <> tz_offset AND tz_offset <> '', false) THEN known_tz ELSE '' END AS prev_tz FROM l"""
)
def hop_zone_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops.with_zone_changes(_hops(spark, sf_dir)).select("node_id", "hop_no", "tz_offset", "tz_changed", "prev_tz")


@query(
    _HOPS_SQL
    + """SELECT node_id, CAST(hop_no AS INTEGER) AS after_hop, CAST(hop_no + 1 AS INTEGER) AS before_hop, CASE WHEN by_hostname <> '' THEN by_hostname ELSE by_ip END AS from_by, next_name AS to_from FROM l
WHERE next_name IS NOT NULL AND NOT (by_hostname <> '' AND (by_hostname = next_name OR by_hostname = next_host)) AND NOT (by_ip <> '' AND by_ip = next_ip)
AND NOT (by_hostname <> '' AND next_name <> '' AND split_part(by_hostname,'.',1) = split_part(next_name,'.',1))"""
)
def hop_chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops.chain_breaks(_hops(spark, sf_dir)).drop("description")


@query(
    _HOPS_SQL
    + """SELECT node_id, arg_min(nullif(from_ip,''), CASE WHEN from_ip = '' OR from_ip LIKE '10.%' THEN 1000000000 ELSE 0 END + hop_no) AS x,
arg_min(CASE WHEN from_ip = '' THEN '-' ELSE from_ip END, CASE WHEN from_ip = '' OR from_ip LIKE '10.%' THEN 1000000000 ELSE 0 END + hop_no) AS origin_ip,
arg_min(from_name, CASE WHEN from_ip = '' OR from_ip LIKE '10.%' THEN 1000000000 ELSE 0 END + hop_no) AS origin_name,
CASE WHEN bool_and(tls <> '') THEN 'TLS' WHEN bool_or(tls <> '') THEN 'partial TLS' ELSE 'no TLS' END AS tls FROM l GROUP BY node_id""".replace(
        "arg_min(nullif(from_ip,''), CASE WHEN from_ip = '' OR from_ip LIKE '10.%' THEN 1000000000 ELSE 0 END + hop_no) AS x,\n", ""
    )
)
def mail_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops.origin(_hops(spark, sf_dir)).withColumn("origin_ip", F.coalesce("origin_ip", F.lit("-")))


@query(_HOPS_SQL + "SELECT * FROM (SELECT node_id, CAST(hop_no AS INTEGER) AS hop_no, row_number() OVER (PARTITION BY node_id ORDER BY hop_no) AS place FROM l WHERE tls = '' AND from_name <> CASE WHEN by_hostname <> '' THEN by_hostname WHEN by_ip <> '' THEN by_ip ELSE '?' END) WHERE place <= 5")
def hops_without_tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops.without_tls(_hops(spark, sf_dir)).select("node_id", "hop_no", "place")


_FROM, _BY = "coalesce(nullif(from_name,''), nullif(from_hostname,''), nullif(from_ip,''), nullif(from_ipv6,''), '?')", "coalesce(nullif(by_hostname,''), nullif(by_ip,''), '?')"
_DELTA_TEXT = """CASE WHEN {d} IS NULL THEN '' WHEN {d} < 0 THEN {d} || 's SKEW' WHEN {d} < 60 THEN {d} || 's' WHEN {d} < 3600 THEN {d} // 60 || 'm' || {d} % 60 || 's' ELSE {d} // 3600 || 'h' || {d} % 3600 // 60 || 'm' END"""


@query(
    _HOPS_SQL
    + f""", d AS (SELECT *, {_FROM} AS f, {_BY} AS b, {_DELTA} AS s, from_ip LIKE '10.%' AS inside, coalesce(known_tz <> tz_offset AND tz_offset <> '', false) AS moved FROM l),
e AS (SELECT *, rtrim(lower(f), '.') = rtrim(lower(b), '.') AS loop FROM d)
SELECT node_id, CAST(hop_no AS INTEGER) AS hop, b AS by_hostname, by_ip, f AS from_name, coalesce(nullif(from_ip,''), nullif(from_ipv6,''), '') AS from_ip, '' AS protocol, tls, '' AS cipher, '' AS server_type,
rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || tz_offset) AS timestamp, s AS delta_seconds, {_DELTA_TEXT.format(d="s")} AS delta_display, tz_offset, moved AS tz_changed, CASE WHEN moved THEN known_tz ELSE '' END AS prev_tz,
tls = '' AND f <> '?' AND NOT loop AS no_tls, inside AS is_internal, concat_ws(',', CASE WHEN inside THEN 'internal' END, CASE WHEN loop THEN 'self-loop' END) AS annotations, '' AS authenticated_sender FROM e"""
)
def hop_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops.display(_hops(spark, sf_dir)).withColumn("annotations", F.array_join("annotations", ",")).drop("inferred_after", "footer")


@query(
    _HOPS_SQL
    + f""", d AS (SELECT *, {_FROM} AS f, {_BY} AS b, {_SECONDS.format(a="ts", b="after")} AS s, from_ip LIKE '10.%' AS inside FROM l),
t AS (SELECT node_id, hop_no, '  ' || hop_no || '. ' || f || CASE WHEN from_ip <> '' AND from_ip <> f THEN ' [' || from_ip || ']' ELSE '' END || ' -> ' || b || CASE WHEN by_ip <> '' AND by_ip <> b THEN ' [' || by_ip || ']' ELSE '' END
|| CASE WHEN tls <> '' THEN ' TLS:' || tls ELSE '' END || CASE WHEN inside THEN ' (internal)' ELSE '' END || CASE WHEN s IS NOT NULL THEN '  (' || {_DELTA_TEXT.format(d="s")} || ')' ELSE '' END
|| '  [' || strftime(ts, '%Y-%m-%d %H:%M:%S') || regexp_replace(tz_offset, '(\\d\\d)(\\d\\d)$', '\\1:\\2') || ']' AS line FROM d)
SELECT node_id, string_agg(line, chr(10) ORDER BY hop_no) AS route FROM t GROUP BY node_id"""
)
def mail_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops.route_text(_hops(spark, sf_dir))


# --- scripts and pages --------------------------------------------------------------------------------------------

_JAVA = {r"(?i)WScript\s*\.\s*Sleep\s*\(\s*(\d+)": r"(?i)WScript\s*\.\s*Sleep\s*\(\s*\d+", r"(?m)^.{5000,}$": r"(?m)^.{1000}.{1000}.{1000}.{1000}.{1000}.*$", r"(?:\\u[0-9a-fA-F]{4}){3,}": r"(?:\\[u][0-9a-fA-F]{4}){3,}"}
_THREAT_ROWS = ", ".join(f"({k}, {s}, {quoted(_JAVA.get(p, p))}, {quoted(n)})" for k, (s, p, n, _) in enumerate(scripts.THREATS))
_SOURCES_SQL = """WITH s AS (SELECT page_id, html || CASE page_id % 7 WHEN 0 THEN ' new ActiveXObject("WScript.Shell").Run("cmd /c x")' WHEN 1 THEN ' MSXML2.XMLHTTP ADODB.Stream WScript.Shell'
 WHEN 2 THEN ' powershell -enc abc; eval(unescape(x))' WHEN 3 THEN ' atob(q); setTimeout("x")' ELSE '' END AS source FROM pages)"""
_THREATS_SQL = f"""{_SOURCES_SQL}, p(ord, severity, pattern, name) AS (VALUES {_THREAT_ROWS}),
m AS (SELECT page_id, name AS pattern, arg_min(severity, ord) AS severity, min(ord) AS ord FROM s JOIN p ON regexp_matches(source, p.pattern) GROUP BY page_id, name)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 7
    more = (
        F.when(k == 0, ' new ActiveXObject("WScript.Shell").Run("cmd /c x")').when(k == 1, " MSXML2.XMLHTTP ADODB.Stream WScript.Shell")
        .when(k == 2, " powershell -enc abc; eval(unescape(x))").when(k == 3, ' atob(q); setTimeout("x")').otherwise("")
    )
    return t(spark, sf_dir, "pages").select("page_id", F.concat("html", more).alias("source"))


@query(_THREATS_SQL + " SELECT page_id, pattern, severity, ord FROM m")
def threat_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.threats(_sources(spark, sf_dir), F.col("source"), "page_id").select("page_id", "pattern", "severity", "ord")


@query(_THREATS_SQL + f" SELECT page_id, bool_or(pattern IN ({sql_list(scripts.DOWNLOAD)})) AND bool_or(pattern IN ({sql_list(scripts.WRITE)})) AND bool_or(pattern IN ({sql_list(scripts.EXECUTE)})) AS kill_chain, min(severity) AS severity FROM m GROUP BY page_id")
def kill_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.kill_chains(scripts.threats(_sources(spark, sf_dir), F.col("source"), "page_id"), "page_id")


@query(_SOURCES_SQL + " SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(substr(source, 1, 2000), {quoted(p)}) THEN {quoted(n)}" for p, n in scripts.LIBRARIES) + " END AS library FROM s")
def script_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).select("page_id", scripts.library(F.col("source")).alias("library"))


@query()
def obfuscation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = _sources(spark, sf_dir).withColumn("m", scripts.metrics(F.col("source")))
    scored = measured.withColumn("o", scripts.obfuscation(F.col("m"), F.col("source")))
    return scored.select("page_id", "m.total_length", "m.line_count", "m.max_line_length", F.round("m.string_literal_ratio", 6).alias("literal_ratio"), "o.score", scripts.score_severity(F.col("o.score")).alias("severity"), F.array_join("o.indicators", "; ").alias("indicators"))


_LINK2 = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)["']?[^>]*>(.*?)</a>"""


@query(f"SELECT page_id, unnest(m) AS href, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos FROM (SELECT page_id, regexp_extract_all(html, {quoted(_LINK2)}, 1) AS m FROM pages)")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.exploded_links(t(spark, sf_dir, "pages"), "html", "page_id").drop("text")


@query("SELECT lower(split_part(split_part(split_part(split_part(url,'://',2),'/',1),':',1),'?',1)) AS host, count(*) AS pages FROM pages GROUP BY 1")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").groupBy(iocs.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query(
    f"""SELECT page_id, CAST(len(regexp_extract_all(html, {quoted(text.FORM)})) AS INTEGER) AS forms, CAST(len(regexp_extract_all(html, {quoted(text.IMAGE)})) AS INTEGER) AS images,
CAST(len(regexp_extract_all(html, {quoted(r"(?is)<script[^>]*>(.*?)</script")})) AS INTEGER) AS scripts FROM pages"""
)
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return t(spark, sf_dir, "pages").select("page_id", F.size(text.html_forms(html)).alias("forms"), F.size(text.html_images(html)).alias("images"), F.size(text.html_scripts(html)).alias("scripts"))


def _html_text_sql() -> str:
    hidden = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<template\\b.*?</template\\s*>|<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({hidden}, '(?s)<[^>]*>', ' ', 'g')"
    for name, sign in text.ENTITIES:
        out = f"replace({out}, {quoted(name)}, {quoted(sign)})"
    return f"SELECT page_id, trim(regexp_replace({out}, '\\s+', ' ', 'g')) AS text FROM pages"


@query(_html_text_sql())
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


# --- text ---------------------------------------------------------------------------------------------------------


@query(
    "WITH w AS (SELECT doc_id, length(trim(text)) AS n, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM documents), s AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{lang}' AS lang, {k} AS rank, count(*) FILTER (WHERE word IN ({sql_list(words)})) AS hits, any_value(n) AS n FROM w GROUP BY doc_id" for k, (lang, words) in enumerate(sorted(text.STOP_WORDS.items())))
    + ") SELECT d.doc_id, d.lang, g.guess FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN any_value(n) >= 10 AND max(hits) > 0 THEN arg_max(lang, hits * 10 - rank) END AS guess FROM s GROUP BY doc_id) g USING (doc_id)"
)
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", "lang", text.language(F.col("text")).alias("guess"))


@query(
    f"""WITH m AS (SELECT doc_id, text || chr(10) || 'Passwort: "geheim' || doc_id || '" bitte nicht' || chr(10) AS text FROM documents),
l AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(text.PASSWORD_LINE)}, 1)) AS rest FROM m),
w AS (SELECT doc_id, trim(trim(trim(unnest(regexp_split_to_array(rest, '\\s+'))), {quoted(chr(34) + chr(39))})) AS password FROM l)
SELECT DISTINCT doc_id, password FROM w WHERE length(password) > 3"""
)
def password_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat("text", F.lit("\nPasswort: \"geheim"), F.col("doc_id").cast("string"), F.lit("\" bitte nicht\n"))
    return t(spark, sf_dir, "documents").select("doc_id", F.explode(text.possible_passwords(made)).alias("password"))


# --- joins, guards, counters --------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def orphan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for parts, events for relationships."""
    refs = t(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return rules.orphans(t(spark, sf_dir, "customer").select("c_custkey"), refs, ["c_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with events stand for parts, orders for relationships."""
    parts = t(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"))
    return rules.dangling(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parts, ["o_custkey"])


@query("SELECT p_brand, list_sort(list(DISTINCT p_type)) AS types FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def type_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.conflicting(t(spark, sf_dir, "part"), "p_brand", value="p_type")


@query(
    """SELECT l_orderkey, count(*) AS members, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS unpacked, CAST(max(CAST(l_quantity AS BIGINT) * 40) AS BIGINT) AS packed,
sum(CAST(floor(l_extendedprice) AS BIGINT)) > 100 * max(CAST(l_quantity AS BIGINT) * 40) OR sum(CAST(floor(l_extendedprice) AS BIGINT)) > 1073741824 AS bomb FROM lineitem GROUP BY l_orderkey"""
)
def archive_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for archives, their lines for members."""
    members = t(spark, sf_dir, "lineitem").select("l_orderkey", F.floor("l_extendedprice").alias("size"), (F.col("l_quantity").cast("long") * 40).alias("archive_size"))
    return rules.archive_guard(members, "l_orderkey", packed="archive_size", unpacked="size")


@query("SELECT event_id, CASE WHEN regexp_matches(event_type, '^sign') THEN 'account' WHEN regexp_matches(event_type, 'click|view') THEN 'read' WHEN regexp_matches(event_type, '^c') THEN 'never' WHEN regexp_matches(event_type, 'e') THEN 'other' END AS label FROM events")
def first_match_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = (("^sign", "account"), ("click|view", "read"), ("^c", "never"), ("e", "other"))
    return t(spark, sf_dir, "events").select("event_id", rules.first_match(F.col("event_type"), table).alias("label"))


@query("SELECT user_id, event_type, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY user_id, event_type")
def kv_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.increment(t(spark, sf_dir, "events").withColumn("updated_at", F.col("ts")), "user_id", "event_type")


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, {'t': ts, 'v': event_type}) AS value FROM events GROUP BY user_id")
def kv_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event: all errors are in the table first, and all events replace them where they are later."""
    rows = t(spark, sf_dir, "events").select(F.lit("last").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("updated_at"))
    return rules.upsert(rows.where("value = 'error'"), rows).select("key", "value")


@query(
    """WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Boss <boss@' || lower(c_mktsegment) || '.example>' ELSE 'boss@corp.example' END AS sender,
 CASE c_custkey % 3 WHEN 0 THEN 'x <Boss@CORP.example>' WHEN 1 THEN 'reply@other.example' END AS reply FROM customer),
d AS (SELECT c_custkey, lower(trim(rtrim(split_part(sender,'@',2), '>'))) AS from_domain, lower(trim(rtrim(split_part(reply,'@',2), '>'))) AS reply_domain FROM m)
SELECT c_custkey, from_domain, reply_domain FROM d WHERE reply_domain IS NOT NULL AND reply_domain <> from_domain"""
)
def reply_to_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.functions.mail import address_domain

    k = F.col("c_custkey")
    sender = F.when(k % 2 == 0, F.concat(F.lit("Boss <boss@"), F.lower("c_mktsegment"), F.lit(".example>"))).otherwise("boss@corp.example")
    reply = F.when(k % 3 == 0, "x <Boss@CORP.example>").when(k % 3 == 1, "reply@other.example")
    rows = t(spark, sf_dir, "customer").select("c_custkey", address_domain(sender).alias("from_domain"), address_domain(reply).alias("reply_domain"))
    return rows.where("reply_domain <> from_domain")


#: What nodes made of documents are called, analysed by, labelled, say and are; together they reach every rule.
_MADE = {
    "analyzer": ("ScriptAnalyzer", "PlainTextAnalyzer", "VBAProjectAnalyzer"),
    "filename": ("a.js", "b.ps1", "c.vbs", "d.bat", "e.txt", "F.HTA", "g.wsf"),
    "label": ("remote_template", "encryption", "macros_found", "entropy", "has_vba"),
    "behaviour": (
        "Registry Run key and rundll32.exe", "HTTP download cradle; Obfuscation score 90 (high)", "PowerShell invocation, then schtasks", "cmd.exe invocation by mshta",
        "an ingress tool transfer", "registry only", "nothing", "Obfuscation score 10 (info)",
    ),
    "script_type": ("", "JavaScript library", "PowerShell", "VBScript", "HTML Application", "JScript", "x", "y", "z", "a", "b"),
}
_RULES_SQL = (
    ("T1221", "label = 'remote_template'"),
    ("T1204.002", "label IN ('macros_found', 'vba_macros', 'has_vba', 'vba_analysis') OR analyzer = 'VBAProjectAnalyzer'"),
    ("T1027.013", "label = 'encryption'"),
    ("T1059.007", "script AND (regexp_matches(name, '\\.(js|jse|hta)$') OR regexp_matches(kind, 'javascript|html application'))"),
    ("T1059.001", "script AND (regexp_matches(name, '\\.(ps1|psm1)$') OR contains(kind, 'powershell') OR contains(b, 'powershell invocation'))"),
    ("T1059.005", "script AND (regexp_matches(name, '\\.(vbs|vbe|wsf|wsh)$') OR contains(kind, 'vbscript'))"),
    ("T1059.003", "script AND (regexp_matches(name, '\\.(bat|cmd)$') OR contains(b, 'cmd.exe invocation'))"),
    ("T1105", "contains(b, 'download cradle') OR contains(b, 'ingress tool transfer')"),
    ("T1027", "contains(b, 'obfuscation score') AND (contains(b, 'high') OR contains(b, 'critical'))"),
    ("T1547.001", "contains(b, 'registry') AND contains(b, 'run')"),
    ("T1053", "contains(b, 'scheduled task') OR contains(b, 'schtasks')"),
    ("T1218.005", "contains(b, 'mshta')"),
    ("T1218.011", "contains(b, 'rundll32')"),
)


@query(
    "WITH d AS (SELECT doc_id, " + ", ".join(f"CASE doc_id % {len(v)} " + " ".join(f"WHEN {k} THEN {quoted(x)}" for k, x in enumerate(v)) + f" END AS {n}" for n, v in _MADE.items()) + " FROM documents), "
    "n AS (SELECT doc_id, analyzer, label, analyzer = 'ScriptAnalyzer' AS script, lower(filename) AS name, lower(behaviour) AS b, lower(script_type) AS kind FROM d) "
    "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {holds} THEN '{i}' END" for i, holds in _RULES_SQL) + ") AS techniques FROM n"
)
def attack_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {n: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("doc_id") % len(v) + 1).cast("int")) for n, v in _MADE.items()}
    ids = rules.techniques(made["filename"], made["analyzer"], F.array(made["label"]), made["behaviour"], made["script_type"])
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(ids, ",").alias("techniques"))


@query(
    """SELECT doc_id, item_id FROM (SELECT d.doc_id, b.item_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY b.item_id) AS n
FROM documents d JOIN benchmark b ON contains(d.text, b.text)) WHERE n = 1"""
)
def contained_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first benchmark item that a document holds word for word; items stand for signatures."""
    signatures = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("signature"))
    return rules.contained(t(spark, sf_dir, "documents"), F.col("text"), signatures, "signature", "doc_id").select("doc_id", F.col("ord").alias("item_id"))


@query(
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS happened, source, event, details FROM (SELECT ts, 'user ' || user_id AS source, event_type AS event, '' AS details FROM events
UNION ALL SELECT o_orderdate, 'customer ' || o_custkey, 'order', o_orderpriority FROM orders)"""
)
def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.operators.timeline import timeline

    s = lambda c: F.col(c).cast("string")
    events = t(spark, sf_dir, "events").select("ts", F.concat(F.lit("user "), s("user_id")).alias("source"), F.col("event_type").alias("event"), F.lit("").alias("details"))
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.concat(F.lit("customer "), s("o_custkey")).alias("source"), F.lit("order").alias("event"), F.col("o_orderpriority").alias("details"))
    return timeline(events, orders).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("happened"), "source", "event", "details")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("n"))


# --- mail, names, types, verdicts ---------------------------------------------------------------------------------

_MAILS_SQL = """SELECT c_custkey AS node_id, 'About ' || c_name AS subject, CASE WHEN c_custkey % 3 > 0 THEN 'Mon, ' || c_custkey END AS date, c_name || ' <' || lower(c_mktsegment) || '@corp.example>' AS "from",
CASE c_custkey % 4 WHEN 0 THEN 'Boss <BOSS@corp.example>, boss@corp.example' WHEN 1 THEN 'a@corp.example, "b@corp.example" <evil@other.example>' WHEN 2 THEN c_name ELSE lower(c_mktsegment) || '@x.example' END AS "to" FROM customer"""


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as messages."""
    k = F.col("c_custkey")
    segment = F.lower("c_mktsegment")
    to = (
        F.when(k % 4 == 0, "Boss <BOSS@corp.example>, boss@corp.example").when(k % 4 == 1, 'a@corp.example, "b@corp.example" <evil@other.example>')
        .when(k % 4 == 2, F.col("c_name")).otherwise(F.concat(segment, F.lit("@x.example")))
    )
    return t(spark, sf_dir, "customer").select(
        k.alias("node_id"), F.concat(F.lit("About "), "c_name").alias("subject"), F.when(k % 3 > 0, F.concat(F.lit("Mon, "), k.cast("string"))).alias("date"),
        F.concat("c_name", F.lit(" <"), segment, F.lit("@corp.example>")).alias("from"), to.alias("to"),
    )


@query(f"""WITH m AS ({_MAILS_SQL}) SELECT '"' || node_id || '","' || subject || '","' || coalesce(date, 'None') || '","' || "from" || '","' || "to" || '"' AS value FROM m""")
def mail_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.sources.sinks import mail_csv

    return mail_csv(_mails(spark, sf_dir))


_CLEAN = "trim(regexp_replace(replace({}, ';', ','), '\\s+', ' ', 'g'))"


@query(
    _HOPS_SQL
    + f"""SELECT concat_ws(';', node_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), {_CLEAN.format("from_name")}, {_CLEAN.format("from_ip")}, {_CLEAN.format("by_hostname || ' ;  via'")}, '', pos) AS value FROM h"""
)
def hop_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.sources.sinks import hop_csv

    rows = _hops(spark, sf_dir).withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "by_hostname": F.concat("by_hostname", F.lit(" ;  via")), "id": F.col("pos")})
    return hop_csv(rows)


_ADDRESSES = r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"


def _from_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).select("node_id", F.lit("From").alias("name"), F.col("to").alias("raw"))


@query(f"""WITH m AS ({_MAILS_SQL}) SELECT DISTINCT unnest(regexp_extract_all(lower("to"), {quoted(_ADDRESSES)})) AS sender FROM m""")
def sender_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.sources.sinks import senders

    return senders(_from_headers(spark, sf_dir))[0]


@query(f"""WITH m AS ({_MAILS_SQL}), a AS (SELECT node_id, regexp_extract_all(lower("to"), {quoted(_ADDRESSES)}) AS found FROM m) SELECT node_id, array_to_string(found, ',') AS addresses FROM a WHERE len(list_distinct(found)) > 1""")
def spoofed_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwood.sources.sinks import senders

    return senders(_from_headers(spark, sf_dir))[1].select("node_id", F.array_join("addresses", ",").alias("addresses"))


_AUTH_SQL = """SELECT c_custkey, 'mx' || c_custkey % 9 || '.example; spf=' || CASE c_custkey % 3 WHEN 0 THEN 'Pass (ok by ' || c_name || ')' WHEN 1 THEN 'softfail' ELSE 'none' END || ' smtp.mailfrom=a@' || lower(c_mktsegment) || '.example;'
|| CASE WHEN c_custkey % 2 = 0 THEN ' dkim=pass header.d=Corp.example;' ELSE '' END || ' dmarc = fail (p=none) header.from=corp.example' AS header FROM customer"""


@query(
    f"""WITH h AS ({_AUTH_SQL}) SELECT c_custkey, trim(split_part(header, ';', 1)) AS authserv_id,
"""
    + ", ".join(
        f"lower(nullif(regexp_extract(header, '(?i){m}\\s*=\\s*(\\w+)', 1), '')) AS {m}, trim(nullif(regexp_extract(header, '(?i){m}\\s*=\\s*\\w+\\s*(\\([^)]+\\))', 1), ''), '()') AS {m}_detail" for m in ("spf", "dkim", "dmarc")
    )
    + """, nullif(regexp_extract(header, '(?i)header\\.from\\s*=\\s*([\\w.\\-@]+)', 1), '') AS header_from, nullif(regexp_extract(header, '(?i)smtp\\.mailfrom\\s*=\\s*([\\w.\\-@]+)', 1), '') AS smtp_mailfrom,
nullif(regexp_extract(header, '(?i)header\\.d\\s*=\\s*([\\w.\\-]+)', 1), '') AS dkim_domain FROM h"""
)
def auth_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authentication-Results lines made of customers, as columns."""
    from siftwood.functions.mail import auth_results

    k, s = F.col("c_custkey"), lambda c: c.cast("string")
    spf = F.when(k % 3 == 0, F.concat(F.lit("Pass (ok by "), "c_name", F.lit(")"))).when(k % 3 == 1, "softfail").otherwise("none")
    header = F.concat(
        F.lit("mx"), s(k % 9), F.lit(".example; spf="), spf, F.lit(" smtp.mailfrom=a@"), F.lower("c_mktsegment"), F.lit(".example;"),
        F.when(k % 2 == 0, " dkim=pass header.d=Corp.example;").otherwise(""), F.lit(" dmarc = fail (p=none) header.from=corp.example"),
    )
    names = ("authserv_id", *(f"{m}{x}" for m in ("spf", "dkim", "dmarc") for x in ("", "_detail")), "header_from", "smtp_mailfrom", "dkim_domain")
    rows = t(spark, sf_dir, "customer").select("c_custkey", header.alias("header"))
    found = auth_results(F.col("header"))
    return rows.select("c_custkey", *[found[n].alias(n) for n in names])


@query(
    """SELECT doc_id, repeat('children/', CAST(doc_id % 3 AS INTEGER)) || CASE WHEN doc_id % 5 > 0 THEN regexp_replace(regexp_replace('a b' || doc_id || '?*.txt', '[ <>|:!&*?/]', '_', 'g'), '_+', '_', 'g') ELSE left(md5(text), 8) || '.txt' END AS named,
repeat('children/', CAST(doc_id % 3 AS INTEGER)) || md5(text) || '.txt' AS hashed FROM documents"""
)
def extraction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document would be extracted to, by its name and by its hash."""
    from siftwood.sources.sinks import extraction_plan

    k = F.col("doc_id")
    name = F.when(k % 5 > 0, F.concat(F.lit("a b"), k.cast("string"), F.lit("?*.txt")))
    nodes = t(spark, sf_dir, "documents").select(k.alias("node_id"), name.alias("filename"), F.md5("text").alias("md5"), F.lit("text/plain").alias("magic_mime"), F.lit(0).alias("idx"), (k % 3).cast("int").alias("level"), F.lit(None).cast("binary").alias("content"))
    named, hashed = (extraction_plan(nodes, names=n).select("node_id", "target") for n in (True, False))
    return named.join(hashed.withColumnRenamed("target", "hashed"), "node_id").select(F.col("node_id").alias("doc_id"), F.col("target").alias("named"), "hashed")


@query(
    """
WITH d AS (SELECT doc_id, encode(text) AS raw, octet_length(encode(text)) AS size FROM documents WHERE octet_length(encode(text)) >= 1024),
p AS (SELECT doc_id, hex(raw) AS h, least(64, size // 1024) AS n, size // least(64, size // 1024) AS block FROM d),
k AS (SELECT doc_id, h, block, unnest(range(n)) AS i FROM p),
b AS (SELECT doc_id, i, block, unnest(regexp_extract_all(substr(h, 2*i*block+1, 2*block), '..')) AS byte FROM k),
c AS (SELECT doc_id, i, block, byte, count(*) AS n FROM b GROUP BY ALL),
e AS (SELECT doc_id, i, -sum(n/block*log2(n/block)) AS entropy FROM c GROUP BY doc_id, i)
SELECT doc_id, string_agg(substr(' ░▒▓█', CAST(least(trunc(entropy / 8 * 4), 4) AS INTEGER) + 1, 1), '' ORDER BY i) AS map FROM e GROUP BY doc_id
"""
)
def entropy_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", content.block_entropy(F.col("text").cast("binary")).alias("blocks"))
    return docs.where(F.size("blocks") > 0).select("doc_id", content.entropy_map(F.col("blocks")).alias("map"))


@query(
    """SELECT page_id, declared, magic, declared IS NOT NULL AND declared <> magic AS mismatch FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' END AS declared,
CASE WHEN regexp_matches(html, '(?i)^\\s*BEGIN:VCALENDAR') THEN 'text/calendar' WHEN regexp_matches(html, '(?i)^\\s*(<!doctype\\s+html|<html[\\s>])') THEN 'text/html' WHEN regexp_matches(html, '(?i)^\\s*<\\?xml') THEN 'text/xml' ELSE 'text/plain' END AS magic FROM pages)"""
)
def type_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    rows = t(spark, sf_dir, "pages").select(
        "page_id", F.when(k % 3 == 0, "text/html").when(k % 3 == 1, "application/pdf").alias("declared"),
        content.detected(F.col("html").cast("binary"), F.lit(None).cast("string"))["mime"].alias("magic"),
    )
    return rows.withColumn("mismatch", content.type_mismatch(F.col("declared"), F.col("magic")))


@query(
    """WITH v AS (SELECT sha256(text) AS sha256, max(CASE WHEN toxic = 1 THEN 3 ELSE 0 END) AS malicious, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS suspicious FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT doc_id, 'VT ' || (malicious + suspicious) || ' hit(s)' AS short, CASE WHEN malicious + suspicious > 0 THEN 1 ELSE 4 END AS severity, 'VirusTotal: malicious=' || malicious || ', suspicious=' || suspicious || ', harmless=7, undetected=0' AS text
FROM documents d JOIN v ON v.sha256 = sha256(d.text)"""
)
def verdict_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table of verdicts, made of labels, says of every document's content."""
    from siftwood.functions import reputation

    docs = t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    made = docs.join(t(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("sha256").alias("value")).agg(
        F.max(F.when(F.col("toxic") == 1, 3).otherwise(0)).alias("malicious"), F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("suspicious")
    )
    verdicts = made.select(F.lit("file").alias("kind"), "value", "malicious", "suspicious", F.lit(7).alias("harmless"), F.lit(0).alias("undetected"))
    nodes = docs.select(F.lit("r").alias("root_id"), F.col("doc_id").alias("node_id"), "sha256")
    return reputation.verdict_reports(nodes, verdicts).select(F.col("node_id").alias("doc_id"), "short", "severity", "text")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS begun, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, session"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a gap of half an hour, by the streaming plan over a whole table."""
    from siftwood.streaming.events import sessions

    return sessions(t(spark, sf_dir, "events")).select("user_id", F.col("session_window.start").alias("begun"), F.col("session_window.end").alias("ended"), "n")


@query(
    """WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS begun FROM events)
SELECT event_type, begun, count(*) AS n FROM s GROUP BY event_type, begun"""
)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an hour, every quarter of an hour, by the streaming plan over a whole table."""
    from siftwood.streaming.events import windowed_counts

    return windowed_counts(t(spark, sf_dir, "events"), "1 hour", slide="15 minutes").select("event_type", F.col("window.start").alias("begun"), "n")


@query(
    """WITH m AS (SELECT doc_id, md5(text) AS m FROM documents), g AS (SELECT doc_id, '{' || substr(m,1,8) || '-' || substr(m,9,4) || '-' || substr(m,13,4) || '-' || substr(m,17,4) || '-' || substr(m,21) || '}' AS guid, upper(m) AS m FROM m)
SELECT doc_id, guid, substr(m,7,2) || substr(m,5,2) || substr(m,3,2) || substr(m,1,2) || substr(m,11,2) || substr(m,9,2) || substr(m,15,2) || substr(m,13,2) || substr(m,17) AS bytes FROM g"""
)
def guid_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.md5("text")
    guid = F.concat(F.lit("{"), F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit("}"))
    rows = t(spark, sf_dir, "documents").select("doc_id", guid.alias("guid"))
    return rows.select("doc_id", "guid", F.hex(content.guid_bytes(F.col("guid"))).alias("bytes"))


@query("SELECT page_id, len(regexp_extract_all(html, '[\\x20-\\x7E]{6,}')) AS runs, array_to_string(regexp_extract_all(html, '[\\x20-\\x7E]{6,}'), '|') AS strings FROM pages")
def printable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "pages").select("page_id", content.printable_strings(F.col("html").cast("binary")).alias("s"))
    return rows.select("page_id", F.size("s").cast("long").alias("runs"), F.array_join("s", "|").alias("strings"))


# --- members, classes of reports, links -----------------------------------------------------------------------------

_MEMBERS_SQL = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '../' || p_name WHEN 1 THEN '/etc/' || p_name WHEN 2 THEN 'C:\\' || p_name WHEN 3 THEN 'a\\..\\' || p_name WHEN 4 THEN 'a..b/' || p_name ELSE p_name END AS name, p_size AS flags FROM part"""


@query(
    f"""WITH m AS ({_MEMBERS_SQL}) SELECT p_partkey, list_contains(string_split(replace(name, '\\', '/'), '/'), '..') AS traverses, starts_with(replace(name, '\\', '/'), '/') OR regexp_matches(name, '^[A-Za-z]:') AS rooted, flags % 2 = 1 AS encrypted FROM m"""
)
def member_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for members of archives, with names that step up or begin at a root, and flags."""
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    heads = ("../", "/etc/", "C:\\", "a\\..\\", "a..b/", "")
    name = F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), (k + 1).cast("int")), n)
    return t(spark, sf_dir, "part").select("p_partkey", rules.traverses(name).alias("traverses"), rules.absolute(name).alias("rooted"), rules.encrypted(F.col("p_size")).alias("encrypted"))


_SHOWN_SQL = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Public Sub x()' || chr(10) || text WHEN 1 THEN 'a.txt <encrypted> [3]' || chr(10) || text WHEN 2 THEN chr(10) || text || chr(10) || 'end' WHEN 3 THEN 'one line' WHEN 4 THEN '  [12] file' ELSE left(text, 40) END AS text,
CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'label' WHEN 2 THEN NULL ELSE 'other' END AS label, CAST(doc_id % 5 AS INTEGER) AS severity FROM documents"""


@query(
    f"""WITH s AS ({_SHOWN_SQL}), l AS (SELECT *, string_split(text, chr(10)) AS lines FROM s)
SELECT doc_id, CASE WHEN regexp_matches(text, '(?im)^\\s*(?:attribute vb_|(?:public |private )?(?:sub|function) \\w)') THEN 'vba'
WHEN len(list_filter(lines[1:5], lambda x: regexp_matches(x, '^\\s*\\[\\d+\\]') OR contains(x, '<encrypted>'))) > 0 THEN 'file_listing'
WHEN coalesce(label, '') = '' AND len(lines) > 1 AND length(text) > 100 THEN 'body_text' WHEN coalesce(label, '') <> '' AND severity = 4 AND len(lines) = 1 THEN 'metadata' ELSE 'plain' END AS class FROM l"""
)
def display_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, line = F.col("doc_id"), F.lit("\n")
    body = (
        F.when(k % 6 == 0, F.concat(F.lit("Public Sub x()\n"), "text")).when(k % 6 == 1, F.concat(F.lit("a.txt <encrypted> [3]\n"), "text"))
        .when(k % 6 == 2, F.concat(line, "text", F.lit("\nend"))).when(k % 6 == 3, "one line").when(k % 6 == 4, "  [12] file").otherwise(F.left("text", F.lit(40)))
    )
    label = F.when(k % 4 == 0, "").when(k % 4 == 1, "label").when(k % 4 == 2, F.lit(None).cast("string")).otherwise("other")
    return t(spark, sf_dir, "documents").select("doc_id", reports.display_class(body, label, (k % 5).cast("int")).alias("class"))


@query(
    """WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '4D5A' WHEN 1 THEN '7F454C46' WHEN 2 THEN '504B0304' ELSE '' END || hex(encode(left(text, 8))) AS h FROM documents)
SELECT doc_id, CASE WHEN starts_with(h, '4D5A') OR left(h, 8) = '7F454C46' THEN 0 WHEN starts_with(h, '504B') THEN 1 ELSE 2 END AS severity FROM p"""
)
def payload_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.element_at(F.array(*[F.lit(h) for h in ("4D5A", "7F454C46", "504B0304", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    raw = F.concat(F.unhex(heads), F.left("text", F.lit(8)).cast("binary"))
    return t(spark, sf_dir, "documents").select("doc_id", scripts.base64_severity(raw).alias("severity"))


@query(
    IOCS_SQL
    + ", c AS (SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in IOC_KINDS)
    + " FROM iocs GROUP BY doc_id) SELECT doc_id, concat_ws(', ', "
    + ", ".join(f"CASE WHEN {k} > 0 THEN {k} || ' {name}' END" for k, name in iocs.NAMES.items())
    + ") AS parts FROM c"
)
def ioc_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t(spark, sf_dir, "documents").select("doc_id", iocs.indicators(F.col("text")).alias("i"))
    return found.where(iocs.total(F.col("i")) > 0).select("doc_id", F.array_join(iocs.summary_parts(F.col("i")), ", ").alias("parts"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_id AS value FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 99)")
def kv_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of users with a costly error go, with all that is stored of them."""
    rows = t(spark, sf_dir, "events").select(F.lit("n").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("value"), "event_type", F.col("value").alias("cost"))
    gone = rows.where("event_type = 'error' and cost > 99").select("namespace", "key").distinct()
    return rules.delete(rows, gone).select("key", "value")


@query(_THREATS_SQL + " SELECT page_id, pattern, severity, place FROM (SELECT page_id, pattern, severity, row_number() OVER (PARTITION BY page_id ORDER BY severity, ord) AS place FROM m) WHERE place <= 3")
def worst_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three gravest threats of each page."""
    found = scripts.threats(_sources(spark, sf_dir), F.col("source"), "page_id")
    return scripts.first_threats_ranked(found, "page_id", n=3).select("page_id", "pattern", "severity", "place")


@query(f"SELECT page_id, array_to_string(regexp_extract_all(html, {quoted(text.IMAGE)}, 1), '|') AS images FROM pages")
def html_image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", F.array_join(text.html_images(F.col("html")), "|").alias("images"))


@query(
    "WITH u AS (SELECT page_id, [url, CASE page_id % 3 WHEN 0 THEN 'https://BIT.ly/' || page_id WHEN 1 THEN 'http://notbitly.example/' || page_id ELSE 'https://t.co/x' END] AS urls FROM pages) "
    f"SELECT page_id, array_to_string(list_filter(urls, lambda x: regexp_matches(lower(x), {quoted('|'.join(d.replace('.', chr(92) + '.') for d in text.SHORTENERS))})), '|') AS short FROM u"
)
def shortened_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    other = F.when(k % 3 == 0, F.concat(F.lit("https://BIT.ly/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("http://notbitly.example/"), k.cast("string"))).otherwise("https://t.co/x")
    return t(spark, sf_dir, "pages").select("page_id", F.array_join(text.shortened_urls(F.array("url", other)), "|").alias("short"))


@query(
    "SELECT doc_id, replace(replace(replace(replace(m, 'hxxp', 'http'), 'HXXP', 'http'), '[.]', '.'), '[@]', '@') AS plain FROM (SELECT doc_id, 'see hxxps://www[.]a' || doc_id || '[.]example or x[@]b[.]example' AS m FROM documents)"
)
def refanged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("see hxxps://www[.]a"), F.col("doc_id").cast("string"), F.lit("[.]example or x[@]b[.]example"))
    return t(spark, sf_dir, "documents").select("doc_id", iocs.refanged(made).alias("plain"))
