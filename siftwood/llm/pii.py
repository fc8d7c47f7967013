"""Personal data by patterns and bootstrapped contexts.

Fixed patterns with checks (Luhn, octets, digit counts) find the plain forms of e-mail and IP addresses, card and phone
numbers.  They are the seeds of a bootstrap over the whole corpus:

1. One pass takes down every seed, every looser candidate (an address with "(at)", a number without its plus, a card of
   unusual length) and every other number, with the words around it as lexical patterns.
2. Patterns and instances form a bipartite graph.  In each round a pattern's confidence for a kind is the share of
   instances of that kind (seeds, and candidates accepted so far) among these and the ones that contradict it: instances
   of other kinds, other numbers, and by `doubt` open candidates that cannot be of the kind.  Open candidates of the kind
   itself say nothing.  A candidate's reliability is that at least one of its confident patterns is right; one that
   equals a seed is reliable from the start.
3. Candidates that end above `accept` are identifiers of that kind, wherever in the corpus they stand.

Graph edges are aggregated, instances are kept as hashes, and joins are between stored tables, so that a pattern beside
a large share of all instances is split over tasks.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm._shared import Scratch, sized_broadcast
from siftwood.runtime import ship

KINDS = ("email", "ip", "card", "phone")
OTHER = "other"

# The forms of the base patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ANY_SIGN = re.compile("[0-9@]|\\bat\\b|AT")

# Looser forms, for candidates.
AT = re.compile(r"\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?|\x20at\x20", re.I)
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\])\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+", re.I)
LOOSE_IP = re.compile(r"[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}(?![0-9])")
NUMBER = re.compile(r"[0-9](?:[\x20().\-/]{0,2}[0-9])*")
BLANK = re.compile(r"\s+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> list[tuple[int, int]]:
    """Linear in the text: from each @ left over the local part (not into the last match), then right over the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Runs of numbers and dots, taken four numbers at a time; parts up to 255."""
    out = []
    for run in DOTTED.finditer(text):
        at, parts = run.start(), run[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) in code points, by kind and start."""
    if not text:
        return []
    found = (emails(text), ips(text), cards(text), phones(text))
    return [(k, a, b) for k, spans in enumerate(found) for a, b in spans]


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _key(value: str) -> str:
    """An instance without its spelling: digits only, or lower case without blanks and brackets."""
    return hashlib.sha256(value.encode()).hexdigest()[:24]


def _patterns(text: str, a: int, b: int, window: tuple[int, int]) -> list[str]:
    """Lexical patterns of a span: the word before, the two words before, the words on both sides."""
    left = BLANK.split(text[max(0, a - window[0]) : a].rpartition("\n")[2].lower())
    right = BLANK.split(text[b : b + window[1]].partition("\n")[0].lower())
    before = [w for w in left if w and not any(c.isdigit() for c in w)][-2:]
    if not before:
        return []
    after = next((w for w in right if w and any(c.isalpha() for c in w) and not any(c.isdigit() for c in w)), None)
    out = [f"{before[-1]} _"]
    if len(before) > 1:
        out.append(" ".join(before) + " _")
    if after:
        out.append(f"{before[-1]} _ {after}")
    return out


class Taken:
    """Spans that are taken, as disjoint stretches in order, so that a look-up is a binary search."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def take(self, a: int, b: int) -> bool:
        """Takes a span that meets none that is taken; False, and nothing, for others."""
        if not self.free(a, b):
            return False
        k = bisect_right(self.ends, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True

    def free(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k == len(self.ends) or self.starts[k] >= b


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind with a ? in front, or other; start; end; value) of what the base patterns leave."""
    taken = Taken([(a, b) for _, a, b in base])
    out = []
    for m in AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in LOCAL_CHARS:  # ends at the last mark at the latest, so this stays linear
            start -= 1
        domain = LOOSE_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain and taken.take(start, domain.end()):
            value = re.sub(r"[\x20()\[\]{}]", "", text[start : m.start()] + "@" + re.sub("dot", ".", domain[0], flags=re.I))
            out.append(("?email", start, domain.end(), value.lower()))
    for m in LOOSE_IP.finditer(text):
        parts = re.findall("[0-9]+", m[0])
        if all(int(p) <= 255 for p in parts) and taken.take(*m.span()):
            out.append(("?ip", *m.span(), ".".join(parts)))
    for m in NUMBER.finditer(text):
        digits = _digits(m[0])
        if len(digits) < 4 or not taken.free(*m.span()):
            continue
        kinds = []
        if 13 <= len(digits) <= 19 and luhn(digits):
            kinds.append("?card")
        if 7 <= len(digits) <= 15:
            kinds.append("?phone")
        for kind in kinds or [OTHER]:
            out.append((kind, *m.span(), digits))
    return out


MENTION = "array<struct<kind:string,a:int,b:int,instance:string,patterns:array<string>>>"
SPAN = "struct<kind:int,a:int,b:int>"
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))
_MENTIONS = pa.list_(
    pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
)


NOTED = f"doc_id long, text_hash long, base array<{SPAN}>, base_sha256 string, mentions {MENTION}, n_edges int"
NOTED_NAMES = ["doc_id", "text_hash", "base", "base_sha256", "mentions", "n_edges"]


def _noted(window: tuple[int, int], size: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                spans, digests, mentions, edges = [], [], [], []
                for text in part.column("text").to_pylist():
                    signs = text and ANY_SIGN.search(text)
                    base = base_spans(text) if signs else []
                    spans.append([{"kind": k, "a": a, "b": b} for k, a, b in base])
                    digests.append(hashlib.sha256(told(base).encode()).hexdigest())
                    own = []
                    if signs:
                        marked = [(KINDS[k], a, b, text[a:b].lower() if k < 2 else _digits(text[a:b])) for k, a, b in base]
                        for kind, a, b, value in marked + _candidates(text, base):
                            patterns = _patterns(text, a, b, window)
                            if patterns or kind != OTHER:
                                own.append({"kind": kind, "a": a, "b": b, "instance": _key(value), "patterns": patterns})
                    mentions.append(own)
                    edges.append(sum(len(m["patterns"]) + 1 for m in own))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(spans, _SPANS), pa.array(digests), pa.array(mentions, _MENTIONS), pa.array(edges, pa.int32())],
                    names=NOTED_NAMES,
                )

    return run


@dataclass(frozen=True)
class BootstrapRules:
    """rounds: of scoring.  seeds: distinct instances of a kind that a pattern needs.  confident: its least confidence.

    doubt: what an open candidate of another kind weighs against a pattern.  accept: a candidate's least reliability.
    window: characters before and after a span in which a pattern's words are looked for, on the span's line; a longer
    word counts by the part that lies in the window.  Spans themselves have no greatest length.
    """

    rounds: int = 3
    seeds: int = 3
    confident: float = 0.8
    doubt: float = 0.5
    accept: float = 0.85
    window: tuple[int, int] = (48, 24)


def bootstrap(noted: DataFrame, rules: BootstrapRules, scratch: Scratch) -> DataFrame:
    """(instance, kind, reliability) of the candidates that are accepted."""
    mentions = noted.select(F.explode("mentions").alias("m")).select("m.kind", "m.instance", "m.patterns")
    edges = mentions.select("kind", "instance", F.explode("patterns").alias("pattern"))
    sides = [F.max(F.col("kind") == f"{mark}{k}").alias(f"{name}_{k}") for mark, name in (("", "is"), ("?", "may")) for k in KINDS]
    n_edges = noted.agg(F.sum("n_edges")).first()[0] or 0
    pairs = scratch.save(edges.groupBy("pattern", "instance").agg(F.max(F.col("kind") == OTHER).alias("other"), *sides), n_edges)
    candidates = scratch.save(
        edges.where(F.col("kind").startswith("?")).select("pattern", "instance", F.substring("kind", 2, 16).alias("kind")).distinct(), n_edges
    )
    n_pairs, n_candidates = pairs.count(), candidates.count()
    named = mentions.where(F.col("kind") != OTHER).select("instance", F.ltrim("kind", F.lit("?")).alias("kind"), F.col("kind").startswith("?").alias("open"))
    # a candidate that equals a seed
    equal = scratch.save(
        named.groupBy("instance", "kind").agg(F.max("open").alias("open"), F.min("open").alias("all_open"))
        .where("open and not all_open")
        .select("instance", "kind", F.lit(1.0).alias("reliability")),
        n_edges // 2,
    )
    n_equal, reliable = equal.count(), equal
    for _ in range(rules.rounds):
        kinds = reliable.groupBy("instance").agg(F.collect_set("kind").alias("kinds"))
        seen = pairs.join(kinds, "instance", "left").select(
            "pattern",
            "other",
            *[F.col(f"may_{k}") for k in KINDS],
            *[(F.col(f"is_{k}") | F.coalesce(F.array_contains("kinds", k), F.lit(False))).alias(f"is_{k}") for k in KINDS],
        )
        told = F.col("other")
        for k in KINDS:
            told = told | F.col(f"is_{k}")
        sums = []
        for k in KINDS:
            against = F.when(F.col(f"is_{k}"), 0.0).when(told, 1.0).when(~F.col(f"may_{k}"), rules.doubt).otherwise(0.0)
            sums.append(F.struct(F.lit(k).alias("kind"), F.count_if(f"is_{k}").alias("n"), F.sum(against).alias("against")))
        patterns = scratch.save(
            seen.groupBy("pattern").agg(F.array(*sums).alias("sums"))
            .select("pattern", F.explode("sums").alias("s"))
            .where(F.col("s.n") >= rules.seeds)
            .select("pattern", "s.kind", F.least(F.col("s.n") / (F.col("s.n") + F.col("s.against")), F.lit(0.99)).alias("confidence"))
            .where(F.col("confidence") >= rules.confident),
            n_pairs,
        )
        found = candidates.join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("reliability")
        )
        before, reliable = reliable, scratch.save(
            found.where(F.col("reliability") >= rules.accept).unionByName(equal).groupBy("instance", "kind").agg(F.max("reliability").alias("reliability")),
            n_candidates + n_equal,
        )
        scratch.drop(patterns)
        if before is not equal:
            scratch.drop(before)
    return reliable


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def find_spans(
    docs: DataFrame, rules: BootstrapRules = BootstrapRules(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, base, base_sha256, added): one row for each row of docs.

    base and added hold (kind, a, b): the number of the kind in KINDS, and code points from a to before b.  A null text
    counts as empty.  Null ids and repeated rows give a row each (rows with equal id and text have equal spans); other
    columns are not read.  An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    noted = scratch.save(_rows(docs, id_col, text_col).mapInArrow(_noted(rules.window), NOTED))
    accepted = bootstrap(noted, rules, scratch)
    key = ["doc_id", "text_hash"]
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    mentioned = (
        noted.where(F.exists("mentions", lambda m: m["kind"].startswith("?")))
        .select(*key, F.explode("mentions").alias("m"))
        .where(F.col("m.kind").startswith("?"))
        .select(*key, F.substring("m.kind", 2, 16).alias("kind"), "m.a", "m.b", "m.instance")
    )
    best = (
        mentioned.join(accepted, ["instance", "kind"])
        .groupBy(*key, "a", "b")
        .agg(F.max(F.struct("reliability", number.alias("number"))).alias("best"))
    )
    added = scratch.save(
        best.groupBy(*key).agg(
            F.array_sort(F.collect_list(F.struct(F.col("best.number").alias("kind"), "a", "b"))).alias("added")
        ),
        noted.count(),
    )
    right = added.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "added")
    n = added.count()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    return (
        noted.drop("mentions", "n_edges")
        .join(sized_broadcast(right, n, 256), same, "left")
        .select(*key, "base", "base_sha256", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"))
    )


def spans_text(spans: "F.Column") -> "F.Column":
    """kind:start:end by kind and start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["a"].cast("string"), s["b"].cast("string"))), ","
    )


def _masked(at_text: int):
    """at_text: the text's place among the columns; the last column is what the bootstrap added."""

    def run(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = []
                for text, added in zip(part.column(at_text).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                    spans = base_spans(text) if text and ANY_SIGN.search(text) else []
                    texts.append(mask(text, spans + [(s["kind"], s["a"], s["b"]) for s in added or []]))
                columns = list(part.columns[:-1])
                columns[at_text] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    return run


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    if not spans:
        return text
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask_documents(docs: DataFrame, rules: BootstrapRules = BootstrapRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span masked in its text; a null text stays null.  Rows and other columns, whatever their names,
    stay as they are; an empty table stays empty."""
    found = find_spans(docs, rules, id_col, text_col).where(F.size("added") > 0).select("doc_id", "text_hash", "added")
    scratch = Scratch(docs.sparkSession)
    extra = scratch.save(found.dropDuplicates(["doc_id", "text_hash"]), docs.count())
    right = extra.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), F.col("added").alias("found_added"))
    names = [f.name for f in docs.schema.fields]
    at_id, at_text = names.index(id_col), names.index(text_col)
    # under numbers, so that no name of docs can clash with one of these columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn(f"c{at_text}", F.col(f"c{at_text}").cast("string"))
    text = F.coalesce(F.col(f"c{at_text}"), F.lit(""))
    same = F.col(f"c{at_id}").cast("long").eqNullSafe(F.col("found_id")) & (F.xxhash64(text) == F.col("found_hash"))
    joined = rows.join(sized_broadcast(right, extra.count(), 256), same, "left").drop("found_id", "found_hash")
    return joined.mapInArrow(_masked(at_text), rows.schema).toDF(*names)
