"""The relations of a triage run and the severity scale."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Severity(IntEnum):
    """Lower is worse, so the minimum over a set is its worst."""

    CRITICAL = 0
    HIGH = 1
    MEDIUM = 2
    LOW = 3
    INFO = 4


NODES = (
    "root_id string, node_id string, parent_id string, path array<int>, level int, idx int, filename string, "
    "mime_type string, declared_mime string, magic_mime string, magic_description string, type_mismatch boolean, "
    "size long, md5 string, sha1 string, sha256 string, analyzer string, metadata map<string,string>, content binary"
)
REPORTS = (
    "root_id string, node_id string, report_key string, label string, severity int, verbosity int, ord int, seq int, "
    "text string, short string, content_type string, data string, replaces string, analyzer string"
)
HOPS = (
    "node_id string, pos int, server_type string, from_name string, from_hostname string, from_ip string, "
    "from_ipv6 string, by_hostname string, by_ip string, protocol string, tls string, cipher string, "
    "envelope_from string, envelope_for string, id string, authenticated_sender string, ts timestamp, "
    "tz_offset string, raw_header string, match_quality int"
)
TIMELINE = "root_id string, ts timestamp, source string, event string, details string"
IOC_KINDS = ("ipv4", "ipv6", "urls", "emails", "domains", "md5", "sha1", "sha256", "passwords")


def severity_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s.name) for s in Severity]), level + 1)


def is_finding(level: Column) -> Column:
    """Severities of MEDIUM or worse are findings; the others inform."""
    return level <= int(Severity.MEDIUM)


def severity_of_rank(rank: Column) -> Column:
    """The severity that a bare rank number stands for."""
    return F.least(rank, F.lit(int(Severity.INFO)))
