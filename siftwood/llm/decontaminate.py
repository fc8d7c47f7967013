"""Benchmark decontamination by spaced seeds.

A mask is a fixed pattern of token positions; those it leaves out are ignored.  The tokens at a mask's positions are
hashed at every place of the benchmark items and of the training texts.  Where the hashes meet, item and text are laid
on each other at that offset, and the stretch around the hit is verified: the longest stretch in which at least
min_identity of the tokens agree must reach min_overlap tokens.  Substituted tokens thus neither hide a hit (they may
fall on ignored positions, of one of several masks) nor break the overlap.

An item of at most min_overlap tokens is laid on the text as a whole: min_identity of its tokens must agree, and tokens
that are substituted or missing at its ends count as any others.  Where that allows m of them, the item is cut into
m + 1 pieces, one of which has to stand in the text unchanged; the pieces are its seeds, so no such place is missed.
Items below min_item tokens are everyday phrases: they count only where they make up a whole line of the text.

Hits are reduced to diagonals (place in the text less place in the item) before anything is verified.  A seed that text
and item both hold many times gives its diagonals by shifts of a bit set, not pair by pair, and diagonals whose
agreeing tokens cannot beat the best overlap so far are passed over, so a text of one repeated word ends as others do.

Items go in blocks whose seeds fit a stated bound, so the table that a task holds never grows with the benchmark; each
block is joined to all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm._shared import ALNUM, binary_text, filter_rows
from siftwood.runtime import ship

#: 1: the token counts; 0: it is ignored.
MASKS = ("11101101", "1101000110101", "110010100100111")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Pairs of equal seeds in one text from which they are put together by shifts.
DENSE = 4096
#: In place of a token behind a short item's end.
FILL = np.uint64(2**64 - 1)
HITS = "doc_id long, item_id long, doc_start long, item_start long, overlap long, matched long"


@dataclass(frozen=True)
class SeedRules:
    """min_overlap, min_identity: what a verified overlap has to reach.  min_item: shorter items have to be a whole line.

    max_seeds: seeds held by a task at once.
    """

    masks: tuple[str, ...] = MASKS
    min_overlap: int = 20
    min_identity: float = 0.8
    min_item: int = 8
    max_seeds: int = 2_000_000


def tokens(raw: bytes) -> list[bytes]:
    """Lower-case runs of digits, a-z and non-ASCII characters."""
    return raw.translate(ALNUM).split()


def offsets(mask: str) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == ord("1"))


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each place of ids (vocabulary numbers, 0: no word of the benchmark) at which the mask fits."""
    at = offsets(mask)
    n = len(ids) - int(at[-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(len(mask)), np.uint64)
    for k in at.tolist():
        out = (out ^ ids[k : k + n]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def needed(n: int, rules: SeedRules) -> int:
    """Tokens of n that have to agree, in whole thousandths as in longest_stretch."""
    return max(1, -(-n * round(rules.min_identity * 1000) // 1000))


def pieces(n: int, need: int) -> list[tuple[int, int]]:
    """n places cut into one piece more than may disagree, so that one piece at least agrees as a whole."""
    k = n - need + 1
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


class SeedIndex:
    """The seeds of a block of items, sorted by hash, with a bit map in front."""

    def __init__(self, items: list[tuple[int, bytes]], rules: SeedRules):
        self.rules = rules
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[np.ndarray] = []
        self.item_ids: list[int] = []
        for item_id, raw in items:
            words = tokens(raw)
            if words:
                self.item_ids.append(item_id)
                self.items.append(
                    np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
                )
        #: Tokens that have to agree where the item is verified as a whole, 0 where it is not.
        self.need = np.array([needed(len(x), rules) if len(x) <= rules.min_overlap else 0 for x in self.items], np.int64)
        short = np.flatnonzero(self.need)
        cuts = {k: pieces(len(self.items[k]), int(self.need[k])) for k in short.tolist()}
        #: The tokens of short items, filled up with a number that no text holds.
        self.width = max((len(self.items[k]) for k in cuts), default=0)
        self.row = np.zeros(len(self.items), np.int64)
        self.row[short] = np.arange(len(short))
        self.whole = np.full((len(short), self.width), FILL)
        for k in cuts:
            self.whole[self.row[k], : len(self.items[k])] = self.items[k]
        self.masks = [*rules.masks, *sorted({"1" * (b - a) for cut in cuts.values() for a, b in cut})]
        number = {mask: m for m, mask in enumerate(self.masks)}
        hashes, owners, places, marks = [], [], [], []

        def note(k: int, m: int, h: np.ndarray, at: np.ndarray) -> None:
            hashes.append(h)
            owners.append(np.full(len(h), k))
            places.append(at)
            marks.append(np.full(len(h), m))

        for k, ids in enumerate(self.items):
            if k in cuts:
                for a, b in cuts[k]:
                    mask = "1" * (b - a)
                    note(k, number[mask], seed_hashes(ids[a:b], mask), np.array([a]))
            else:
                for mask in rules.masks:
                    h = seed_hashes(ids, mask)
                    note(k, number[mask], h, np.arange(len(h)))
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        h, self.owner, self.place, self.mark = (cat(x, t) for x, t in ((hashes, np.uint64), (owners, np.int32), (places, np.int64), (marks, np.int32)))
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place, self.mark = h[order], self.owner[order], self.place[order], self.mark[order]
        self.bits = min(26, max(16, int(len(h) * 64).bit_length()))
        self.shift = np.uint64(64 - self.bits)
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self.hash >> self.shift] = True

    def hits(self, ids: np.ndarray, starts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, diagonal) where seeds are equal, about most pairs of them at a time.

        starts: where each text begins in ids; a diagonal is the place in ids at which the item's first token would lie.
        """
        for m, mask in enumerate(self.masks):
            h = seed_hashes(ids, mask)
            places = np.flatnonzero(self.map[h >> self.shift])
            begin = np.searchsorted(self.hash, h[places], "left")
            counts = np.searchsorted(self.hash, h[places], "right") - begin
            places, begin, counts = places[counts > 0], begin[counts > 0], counts[counts > 0]
            if not len(places):
                continue
            text = np.searchsorted(starts, places, "right") - 1
            order = np.lexsort((places, begin, text))
            places, begin, counts, text = places[order], begin[order], counts[order], text[order]
            heads = np.flatnonzero(np.append(True, (begin[1:] != begin[:-1]) | (text[1:] != text[:-1])))
            sizes = np.diff(np.append(heads, len(places)))
            dense = sizes * counts[heads] > DENSE
            for g in np.flatnonzero(dense).tolist():
                first = heads[g]
                yield from self._shifted(m, int(text[first]), places[first : first + sizes[g]], int(begin[first]), int(counts[first]))
            thin = ~np.repeat(dense, sizes)
            places, begin, counts, text = places[thin], begin[thin], counts[thin], text[thin]
            part = np.cumsum(counts) // most
            for first_of, end_of in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right"))):
                first, count = begin[first_of:end_of], counts[first_of:end_of]
                entry = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                same = self.mark[entry] == m
                entry = entry[same]
                at = np.repeat(places[first_of:end_of], count)[same]
                yield np.repeat(text[first_of:end_of], count)[same], self.owner[entry].astype(np.int64), at - self.place[entry]

    def _shifted(self, m: int, text: int, places: np.ndarray, begin: int, count: int):
        """The diagonals of one seed's places in a text with all of its places in each item."""
        entry = np.arange(begin, begin + count)
        entry = entry[self.mark[entry] == m]
        low = int(places[0])
        for k in np.unique(self.owner[entry]).tolist():
            inner = self.place[entry[self.owner[entry] == k]]
            last = int(inner.max())
            wide, narrow = (places - low, last - inner) if len(places) > len(inner) else (last - inner, places - low)
            bits, found = _bit_set(wide), 0
            for shift in narrow.tolist():
                found |= bits << shift
            raw = np.frombuffer(found.to_bytes((found.bit_length() + 7) // 8, "little"), np.uint8)
            diagonals = np.flatnonzero(np.unpackbits(raw, bitorder="little")) + low - last
            yield np.full(len(diagonals), text), np.full(len(diagonals), k, np.int64), diagonals


def _bit_set(numbers: np.ndarray) -> int:
    bits = np.zeros(int(numbers.max()) + 1, np.uint8)
    bits[numbers] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def longest_stretch(equal: np.ndarray, identity: float) -> tuple[int, int]:
    """The longest [a, b) in which at least the share identity of equal is true, begun and ended by a true one."""
    # compared in whole thousandths, so that a share of exactly identity counts
    score = np.concatenate(([0], np.cumsum(np.where(equal, 1000 - round(identity * 1000), -round(identity * 1000)))))
    n = len(equal)
    best = (0, 0)
    # left ends: places whose score is below all before them; right ends: above all after them
    left = [i for i in range(n) if equal[i]]
    right_best = np.maximum.accumulate(score[::-1])[::-1]
    low = None
    j = 0
    for i in left:
        if low is not None and score[i] >= low:
            continue
        low = score[i]
        j = max(j, i + 1)
        while j <= n and right_best[j] >= score[i]:
            j += 1
        end = j - 1
        while end > i and not (score[end] >= score[i] and equal[end - 1]):
            end -= 1
        if end - i > best[1] - best[0]:
            best = (i, end)
    return best


def longest_stretches(equal: np.ndarray, identity: float) -> tuple[np.ndarray, np.ndarray]:
    """longest_stretch of each row of a matrix, as arrays of a and b."""
    rows, n = equal.shape
    gain, loss = 1000 - round(identity * 1000), round(identity * 1000)
    score = np.zeros((rows, n + 1), np.int64)
    np.cumsum(np.where(equal, gain, -loss), axis=1, out=score[:, 1:])
    never = np.int64(1) << 60
    low = np.minimum.accumulate(np.where(equal, score[:, :-1], never), axis=1)
    high = np.maximum.accumulate(np.where(equal, score[:, 1:], -never)[:, ::-1], axis=1)[:, ::-1]
    # i and j only move on: j while some end at or after it goes with a beginning at or before i, else i
    i, j = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    best, at, live = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.arange(rows)
    while len(live):
        a, b = i[live], j[live]
        fits = low[live, a] <= high[live, b]
        longer = fits & (b + 1 - a > best[live])
        best[live[longer]], at[live[longer]] = (b + 1 - a)[longer], a[longer]
        j[live[fits]] += 1
        i[live[~fits]] += 1
        live = live[(i[live] < n) & (j[live] < n)]
    return at, at + best


class Searcher:
    """Finds the verified overlaps of many texts at once with the items of one index."""

    def __init__(self, index: SeedIndex):
        self.index, self.rules = index, index.rules
        # so that neither a mask nor a short item reaches over a text's ends into another text
        self.gap = [0] * max(index.width, *(len(m) for m in index.masks), 1)

    def _verified(self, ids: np.ndarray, k: int, diagonals: np.ndarray) -> tuple[int, int, int, int] | None:
        """The best overlap of a text with an item over these diagonals: the longest, then that with most matches, then
        the earliest."""
        other = self.index.items[k]
        m, n = len(other), len(ids)
        best: tuple[int, int, int] | None = None  # overlap, matches, -place
        if len(diagonals) * m <= 4096:
            for d in diagonals.tolist():
                a, b = max(0, d), min(n, d + m)
                equal = ids[a:b] == other[a - d : b - d]
                i, j = longest_stretch(equal, self.rules.min_identity)
                if j - i >= self.rules.min_overlap:
                    found = (j - i, int(equal[i:j].sum()), -(a + i), -d)
                    best = max(best, found) if best else found
        else:
            step, width = max(1, (1 << 22) // m), np.arange(m)

            def laid(some: np.ndarray) -> np.ndarray:
                at = some[:, None] + width
                return (at >= 0) & (at < n) & (ids[np.clip(at, 0, n - 1)] == other)

            def bounds(equal: np.ndarray) -> np.ndarray:
                # a stretch begins and ends with agreeing tokens, and so many of it have to agree
                spans = m - equal.argmax(axis=1) - equal[:, ::-1].argmax(axis=1)
                matches = equal.sum(axis=1)
                return np.stack([np.minimum(spans, matches * 1000 // round(self.rules.min_identity * 1000)), matches])

            most, matches = np.concatenate([bounds(laid(diagonals[lo : lo + step])) for lo in range(0, len(diagonals), step)], axis=1)
            order = np.lexsort((diagonals, -matches, -most))
            order = order[most[order] >= self.rules.min_overlap]
            step = max(1, min(step, 1024))
            for lo in range(0, len(order), step):
                some = order[lo : lo + step]
                if best and (int(most[some[0]]), int(matches[some[0]]), -max(0, int(diagonals[order[lo:]].min()))) <= best[:3]:
                    break
                equal = laid(diagonals[some])
                i, j = longest_stretches(equal, self.rules.min_identity)
                sums = np.concatenate((np.zeros((len(some), 1), np.int64), np.cumsum(equal, axis=1)), axis=1)
                agree = np.take_along_axis(sums, j[:, None], 1)[:, 0] - np.take_along_axis(sums, i[:, None], 1)[:, 0]
                for r in np.flatnonzero(j - i >= self.rules.min_overlap).tolist():
                    d = int(diagonals[some[r]])
                    found = (int(j[r] - i[r]), int(agree[r]), -(d + int(i[r])), -d)
                    best = max(best, found) if best else found
        if best is None:
            return None
        overlap, matched, place, d = best
        return -place, -place + d, overlap, matched

    def _laid(self, ids, starts, sizes, text: np.ndarray, item: np.ndarray, begin: np.ndarray, lines: Callable, most: int = 1 << 16):
        """(number of the text, item, overlap) where enough of a short item's tokens agree, each in its place."""
        width, index = np.arange(self.index.width), self.index
        for lo in range(0, len(begin), most):
            k, first = item[lo : lo + most], begin[lo : lo + most]
            equal = (ids[np.minimum(first[:, None] + width, len(ids) - 1)] == index.whole[index.row[k]]).sum(axis=1)
            for g in np.flatnonzero(equal >= index.need[k]).tolist():
                t, n = int(text[lo + g]), len(index.items[k[g]])
                d = int(first[g] - starts[t])
                if n < self.rules.min_item and (d, d + n) not in lines(t):
                    continue
                a, b = max(0, d), min(int(sizes[t]), d + n)
                yield t, index.item_ids[k[g]], (a, a - d, b - a, int(equal[g]))

    def overlaps(self, texts: list[bytes]) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
        """(number of the text, item, (doc_start, item_start, overlap, matched)): the best of each text and item."""
        get = self.index.vocabulary.get
        row: list[int] = list(self.gap)
        begins, lengths = [], []
        for raw in texts:
            begins.append(len(row))
            row += [get(w, 0) for w in tokens(raw)]
            lengths.append(len(row) - begins[-1])
            row += self.gap
        ids, starts, sizes = np.array(row, np.uint64), np.array(begins), np.array(lengths)
        best: dict[tuple[int, int], tuple] = {}
        spans: dict[int, set] = {}

        def lines(t: int) -> set[tuple[int, int]]:
            """Where the lines of a text begin and end, in tokens."""
            if t not in spans:
                ends = np.cumsum([0, *(len(tokens(x)) for x in texts[t].split(b"\n"))]).tolist()
                spans[t] = set(zip(ends, ends[1:]))
            return spans[t]

        def note(t: int, k: int, found: tuple) -> None:
            old = best.get((t, k))
            if old is None or (found[2], found[3], -found[0]) > (old[2], old[3], -old[0]):
                best[t, k] = found

        long: list[np.ndarray] = []
        for found in self.index.hits(ids, starts):
            text, item, begin = (x.astype(np.int64) for x in found)
            whole = self.index.need[item] > 0
            for t, k, laid in self._laid(ids, starts, sizes, text[whole], item[whole], begin[whole], lines):
                note(t, k, laid)
            if not whole.all():
                long.append(np.unique(np.stack([x[~whole] for x in (text, item, begin)]), axis=1))
                if sum(x.shape[1] for x in long) > 1 << 22:  # a diagonal that many seeds hit is kept once
                    long = [np.unique(np.concatenate(long, axis=1), axis=1)]
        if long:
            text, item, begin = np.unique(np.concatenate(long, axis=1), axis=1)
            heads = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(text)]):
                t, k = int(text[a]), int(item[a])
                own = ids[begins[t] : begins[t] + lengths[t]]
                found = self._verified(own, k, begin[a:b] - begins[t])
                if found:
                    note(t, self.index.item_ids[k], found)
        for t, k in sorted(best, key=lambda x: (x[0], x[1] is None, x[1] or 0)):
            yield t, k, best[t, k]


def _found(sent):
    def run(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
        search = Searcher(sent.value)
        names = [x.split()[0] for x in HITS.split(", ")]
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                part = batch.slice(first, size)
                ids = part.column(0).to_pylist()
                out = [(ids[t], k, *v) for t, k, v in search.overlaps(part.column(1).to_pylist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def _clean(sent):
    def decide():
        search = Searcher(sent.value)

        def keep(batch: pa.RecordBatch) -> list[bool]:
            leaky = {t for t, _, _ in search.overlaps(batch.column("raw").to_pylist())}
            return [i not in leaky for i in range(batch.num_rows)]

        return keep

    return decide


def indexes(benchmark: DataFrame, rules: SeedRules, item_col: str, item_text_col: str) -> Iterator:
    """Broadcast indexes over blocks of the items, of about max_seeds seeds each at most; one item is never parted."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), binary_text(item_text_col).alias("raw"))
    # a word needs two bytes with its space, and each mask makes a seed at most for each word
    size = items.agg(F.sum(F.octet_length("raw") / 2 + 1)).first()[0] or 0
    blocks = max(1, -(-int(size * len(rules.masks)) // rules.max_seeds))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(blocks)) == k).collect()
        index = SeedIndex([(r["item_id"], bytes(r["raw"])) for r in block], rules)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rules: SeedRules = SeedRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, overlap, matched): the best overlap of each document and item that has one.

    Places and lengths count tokens; of equal overlaps the one with more matches, then the earlier, is told.  Null
    texts count as empty, and empty items match nothing.  Rows with a null id are searched and told with a null id;
    repeated rows of docs give repeated results, items with one id count as one; other columns are not read.  An empty
    table of either kind gives an empty result.
    """
    ship(docs.sparkSession)
    searched = docs.select(F.col(id_col).cast("long").alias("doc_id"), binary_text(text_col).alias("raw"))
    parts = [searched.mapInArrow(_found(sent), HITS) for sent in indexes(benchmark, rules, item_col, item_text_col)]
    return reduce(DataFrame.unionByName, parts)


def remove_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rules: SeedRules = SeedRules(),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of docs, all columns as they are, that share a verified overlap with no item."""
    ship(docs.sparkSession)
    for sent in indexes(benchmark, rules, item_col, item_text_col):
        docs = filter_rows(docs, text_col, _clean(sent))
    return docs
