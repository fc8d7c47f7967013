"""Indicators of compromise in text, as native expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.schema import IOC_KINDS

# The forms of indicators, words that are no password, domains that are noise, private networks.
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\b"
IPV6 = (
    r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b"
    r"|\b(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}\b|\b::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}\b"
)
#: Not cut short before a compressed tail, and found without a digit in front.
IPV6_FULL = (
    r"(?<![0-9a-fA-F:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?)(?![0-9a-fA-F:])"
)
URL = r"(?i)(?:h[tx]{2}ps?|ftp)://[^\s<>\"'\)\]\}]{3,}"
URL_TAIL = r"[.,;:!?'\")]+$"
EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+(?:[a-zA-Z]{2,13})\b"
MD5 = r"\b[0-9a-fA-F]{32}\b"
SHA1 = r"\b[0-9a-fA-F]{40}\b"
SHA256 = r"\b[0-9a-fA-F]{64}\b"
PASSWORD = r"(?i)(?:pw|kennwort|passwor[dt]|password|passcode)\s*[:\-=\s]\s*(\S+)"
NOT_PASSWORDS = ("the", "your", "this", "that", "with")
SKIPPED_DOMAINS = (
    "w3.org", "schemas.openxmlformats.org", "schemas.microsoft.com", "www.w3.org", "xml.org", "xmlsoap.org",
    "purl.org", "example.com", "example.org", "example.net",
)
PRIVATE_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")

NAMES = {"ipv4": "IPv4", "ipv6": "IPv6", "urls": "URL", "emails": "Email", "domains": "Domain", "md5": "MD5", "sha1": "SHA1", "sha256": "SHA256", "passwords": "Password"}


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, then) -> Column:
    """then(value) with value computed once: inside, it is a lambda's variable, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def distinct_folded(values: Column) -> Column:
    """The values without repeats that differ in case only; the first spelling stays, in order."""

    def firsts(v: Column) -> Column:
        several = let(F.transform(v, F.lower), lambda folded: F.filter(v, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1))
        return F.when(F.size(v) < 2, v).otherwise(several)

    return let(values, firsts)


def ip_number(ip: Column) -> Column:
    """A dotted quad as a number; null if it is none."""
    parts = F.split(ip, r"\.")
    byte = lambda k: F.get(parts, F.lit(k)).try_cast("long")
    return ((byte(0) * 256 + byte(1)) * 256 + byte(2)) * 256 + byte(3)


def in_network(ip: Column, network: str) -> Column:
    """Whether an address lies in a network, by a range of numbers."""
    base, bits = network.split("/")
    low = 0
    for part in base.split("."):
        low = low * 256 + int(part)
    return F.coalesce(ip_number(ip).between(low, low + (1 << 32 - int(bits)) - 1), F.lit(False))


def is_private(ip: Column) -> Column:
    found = F.lit(False)
    for network in PRIVATE_NETWORKS:
        found = found | in_network(ip, network)
    return found


def refanged(text: Column) -> Column:
    """Undoes common ways to make indicators unclickable."""
    for pattern, plain in ((r"(?i)hxxp", "http"), (r"(?i)\[(?:\.|dot)\]|\((?:\.|dot)\)", "."), (r"(?i)\[(?:@|at)\]|\((?:@|at)\)", "@"), (r"\[:(?://)?\]", ":")):
        text = F.regexp_replace(text, pattern, plain)
    return text


def url_host(url: Column) -> Column:
    """What follows ://, cut at the first of / : ? in that order."""
    rest = F.element_at(F.split(url, "://", 2), -1)
    for mark in ("/", ":", "?"):
        rest = F.split_part(rest, F.lit(mark), F.lit(1))
    return F.lower(rest)


def indicators(
    text: Column, include_private: bool = False, skip_domains: Iterable[str] = (), refang: bool = False, strict: bool = True
) -> Column:
    """A struct with an array for each kind, without repeats, in order of the text.

    A longer hash is told as that kind only; addresses ending in .0.0 pass for version numbers; a domain is left out
    when it is on the skip list, belongs to a found address or URL, or has two labels with three letters or fewer in
    front.  strict keeps the short form of compressed IPv6 addresses; otherwise they are found whole.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    if refang:
        text = refanged(text)
    none = F.array().cast("array<string>")

    def found(pattern: str, sign: Column, group: int = 0) -> Column:
        """Matches where a cheap sign of them occurs: most texts hold none, and are not searched."""
        return F.when(sign, matches(text, pattern, group)).otherwise(none)

    has = lambda s: F.contains(text, F.lit(s))
    ips = F.filter(found(IPV4, text.rlike(r"\d\.\d")), lambda ip: ~ip.endswith(".0.0") & (F.lit(include_private) | ~is_private(ip)))
    urls = F.filter(F.transform(found(URL, has("://")), lambda u: F.regexp_replace(u, URL_TAIL, "")), lambda u: F.length(u) > 10)
    passwords = F.filter(found(PASSWORD, text.rlike("(?i)pw|kennwort|passw|passcode"), 1), lambda p: (F.length(p) >= 4) & ~F.lower(p).isin(*NOT_PASSWORDS))
    skipped = F.array(*[F.lit(d) for d in sorted({*SKIPPED_DOMAINS, *skip_domains})])

    def domains(emails: Column, addresses: Column) -> Column:
        seen = F.concat(F.transform(emails, lambda e: F.lower(F.split_part(e, F.lit("@"), F.lit(2)))), F.transform(addresses, url_host))

        def telling(known: Column):
            def keep(d: Column) -> Column:
                labels = F.split(F.lower(d), r"\.")
                short = (F.size(labels) == 2) & (F.length(F.get(labels, F.lit(0))) <= 3)
                return ~F.array_contains(skipped, F.lower(d)) & ~F.array_contains(known, F.lower(d)) & ~short

            return keep

        return let(seen, lambda known: distinct_folded(F.filter(found(DOMAIN, text.rlike(r"[a-zA-Z0-9]\.[a-zA-Z0-9]")), telling(known))))

    def whole(x: Column) -> Column:
        return F.struct(
            distinct_folded(ips).alias("ipv4"),
            distinct_folded(found(IPV6 if strict else IPV6_FULL, has(":"))).alias("ipv6"),
            x["u"].alias("urls"),
            x["e"].alias("emails"),
            domains(x["e"], x["u"]).alias("domains"),
            distinct_folded(found(MD5, x["hex"])).alias("md5"),
            distinct_folded(found(SHA1, x["hex"])).alias("sha1"),
            distinct_folded(found(SHA256, x["hex"])).alias("sha256"),
            distinct_folded(passwords).alias("passwords"),
        )

    parts = F.struct(
        distinct_folded(urls).alias("u"), distinct_folded(found(EMAIL, has("@"))).alias("e"), text.rlike("[0-9a-fA-F]{32}").alias("hex")
    )
    return let(parts, whole)


def long_indicators(nodes: DataFrame, text: Column, *keys: str, **settings) -> DataFrame:
    """(keys, kind, value, pos): one row for each indicator of each row; pos counts within the kind, from 0."""
    found = nodes.select(*keys, indicators(text, **settings).alias("found"))

    def rows(kind: str) -> Column:
        return F.transform(f"found.{kind}", lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("pos")))

    each = F.flatten(F.array(*map(rows, IOC_KINDS)))
    return found.select(*keys, F.explode(each).alias("i")).select(*keys, "i.kind", "i.value", "i.pos")


def merged(iocs: DataFrame, *groups: str, order: list[str]) -> DataFrame:
    """(groups, kind, value, first): indicators of many nodes in one, in the spelling that comes first by order."""
    rank = F.struct(*order)
    return (
        iocs.groupBy(*groups, "kind", F.lower("value").alias("folded"))
        .agg(F.min_by("value", rank).alias("value"), F.min(rank).alias("first"))
        .drop("folded")
    )


def defanged(kind: Column, value: Column) -> Column:
    """An indicator in a form that nothing makes a link of."""
    url = F.replace(F.replace(F.replace(value, F.lit("http://"), F.lit("hxxp://")), F.lit("https://"), F.lit("hxxps://")), F.lit("ftp://"), F.lit("fxp://"))
    return (
        F.when(kind.isin("ipv4", "ipv6", "domains"), F.replace(value, F.lit("."), F.lit("[.]")))
        .when(kind == "urls", url)
        .when(kind == "emails", F.replace(value, F.lit("@"), F.lit("[@]")))
        .otherwise(value)
    )


def total(found: Column) -> Column:
    out = F.lit(0)
    for k in IOC_KINDS:
        out = out + F.size(found[k])
    return out


def summary_parts(found: Column) -> Column:
    """\"3 IPv4\", \"1 Email\" and so on, for kinds that occur."""
    return F.array_compact(
        F.array(*[F.when(F.size(found[k]) > 0, F.concat_ws(" ", F.size(found[k]).cast("string"), F.lit(name))) for k, name in NAMES.items()])
    )


def severity(found: Column) -> Column:
    """MEDIUM where there is a URL or an IPv4 address, else INFO."""
    return F.when((F.size(found["urls"]) > 0) | (F.size(found["ipv4"]) > 0), F.lit(2)).otherwise(F.lit(4))


def summary_lines(found: Column) -> Column:
    """The sections of the roll-up: addresses of both versions together, passwords left out."""
    sections = (("IPs", F.concat(found["ipv4"], found["ipv6"])), ("Domains", found["domains"]), ("URLs", found["urls"]), ("Emails", found["emails"]), ("MD5", found["md5"]), ("SHA1", found["sha1"]), ("SHA256", found["sha256"]))
    return F.array_compact(F.array(*[F.when(F.size(v) > 0, F.concat(F.lit(f"{name}: "), F.array_join(v, ", "))) for name, v in sections]))


def enriched(iocs: DataFrame, verdicts: DataFrame, *keys: str, budget: int = 10) -> DataFrame:
    """Indicators of domains, then addresses, with verdicts by value; the first budget of each group that have one."""
    from pyspark.sql import Window

    rank = F.when(F.col("kind") == "domains", 0).when(F.col("kind") == "ipv4", 1).otherwise(2)
    known = iocs.where(F.col("kind").isin("domains", "ipv4", "ipv6")).join(verdicts, ["value"])
    order = Window.partitionBy(*keys).orderBy(rank, "pos", "value")
    return known.withColumn("lookup", F.row_number().over(order)).where(F.col("lookup") <= budget)
