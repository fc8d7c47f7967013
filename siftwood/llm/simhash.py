"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Each text gets a 64-bit fingerprint: the bitwise majority of the XXH64 of its 3-word shingles.
2. Equal fingerprints collapse to one row with the smallest doc_id, by a partial aggregate.
3. Two fingerprints at 3 or fewer differing bits agree on at least one of four 16-bit blocks, so every fingerprint is
   dealt to the four buckets (mask, fingerprint & mask).  A bucket above max_bucket rows is dealt again over four parts
   of its still free bits, by the same argument, as often as needed: no bucket is capped and no link is lost.
4. A task holds many buckets.  It sorts them by Gray rank, which puts fingerprints that share bits side by side, and
   builds a tree in which each node keeps the bits common to its group (mask and pattern) that its parent has not
   already accounted for.  A search adds up the differences on those masks from the root down: a group whose sum
   exceeds the radius goes as a whole; a group that is one component already, together with the searching row, goes too.
5. Each task emits a star per local component, never its pairs; alternating large-star and small-star steps over these
   edges give the components over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm._shared import LOWER, Scratch, binary_text, drop_ids, sized_broadcast, tasks_for
from siftwood.runtime import ship

SEED = 42
SHINGLE = 3
ALL_BITS = (1 << 64) - 1


# --- fingerprints -------------------------------------------------------------------------------------------------


def fingerprint(raw: bytes) -> int:
    """The 64-bit SimHash of a text's UTF-8 bytes, as an unsigned number; 0 if it has no word."""
    words = raw.translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - SHINGLE])).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    digest, step = xxhash.xxh64_digest, 1 << 16
    for at in range(0, len(starts), step):
        packed = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + step], stops[at : at + step])])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            found = np.array([fingerprint(x) for x in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "fp"])


# --- the index over the buckets of one task ----------------------------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the reflected Gray code's order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Components:
    """Labels of rows, where each label is the smallest row of its component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                shorter = label[label]
                if np.array_equal(shorter, label):
                    break
                label = shorter
        self.label = label


def _runs(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive groups that begin at starts: each group's size, and the group of each of n members."""
    sizes = np.diff(np.append(starts, n))
    return sizes, np.repeat(np.arange(len(starts)), sizes)


class GrayTree:
    """Nodes over rows that are sorted by (bucket, Gray rank); levels[0] groups rows, the last has a node per bucket."""

    def __init__(self, fp: np.ndarray, bucket_starts: np.ndarray, fan: int):
        n = len(fp)
        _, bucket_of = _runs(bucket_starts, n)
        self.levels: list[dict] = []
        low, high, owner, first_row = fp, fp, bucket_of, np.arange(n)
        while True:
            # children of one bucket in groups of fan, in order
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            place = np.arange(len(owner)) - np.repeat(head, np.diff(np.append(head, len(owner))))
            starts = np.flatnonzero(place % fan == 0)
            sizes, parent = _runs(starts, len(owner))
            low_up, high_up = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            common = ~(low_up ^ high_up)
            if self.levels:  # a child keeps what its parent does not share
                self.levels[-1]["residual"] &= ~common[parent]
            rows = first_row[starts]
            self.levels.append(
                {"child": starts, "size": sizes, "common": common, "residual": common.copy(), "pattern": low_up & common, "rows": rows}
            )
            owner, low, high, first_row = owner[starts], low_up, high_up, rows
            if len(owner) == len(bucket_starts):
                break
        self.n, self.bucket_of = n, bucket_of

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level: the node's component if all of its rows are in one, else -1."""
        out = []
        for level in self.levels:
            low, high = np.minimum.reduceat(label, level["rows"]), np.maximum.reduceat(label, level["rows"])
            out.append(np.where(low == high, low, -1))
        return out


def local_components(mask: np.ndarray, fp: np.ndarray, radius: int = 3, fan: int = 8, frontier: int = 1 << 21):
    """(order, label): rows sorted by bucket and Gray rank, and the smallest sorted row in reach within the buckets."""
    order = np.lexsort((gray_rank(fp), fp & mask, mask))
    fp, mask = fp[order], mask[order]
    n = len(fp)
    parts = Components(n)
    if n < 2:
        return order, parts.label
    key = fp & mask
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])))
    sizes = np.diff(np.append(starts, n))
    tree = GrayTree(fp, starts, fan)
    near = (tree.bucket_of[1:] == tree.bucket_of[:-1]) & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= radius)
    parts.join(np.flatnonzero(near), np.flatnonzero(near) + 1)
    askers = np.flatnonzero(sizes[tree.bucket_of] > 1)
    step = max(4096, len(askers) // 64)
    for at in range(0, len(askers), step):
        some = askers[at : at + step]
        uniform = tree.uniform(parts.label)
        todo = [(len(tree.levels) - 1, some, tree.bucket_of[some], np.zeros(len(some), np.uint8))]
        while todo:
            depth, row, node, sum_ = todo.pop()
            if len(row) > frontier:  # the frontier is worked off in parts, so its size is bounded
                half = len(row) // 2
                todo += [(depth, row[half:], node[half:], sum_[half:]), (depth, row[:half], node[:half], sum_[:half])]
                continue
            level = tree.levels[depth]
            sum_ = sum_ + np.bitwise_count((fp[row] ^ level["pattern"][node]) & level["residual"][node])
            keep = (sum_ <= radius) & (uniform[depth][node] != parts.label[row])
            row, node, sum_ = row[keep], node[keep], sum_[keep]
            if not len(row):
                continue
            count = level["size"][node]
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            child, asker = np.repeat(level["child"][node], count) + inner, np.repeat(row, count)
            if depth:
                todo.append((depth - 1, asker, child, np.repeat(sum_, count)))
            else:
                hit = np.bitwise_count(fp[asker] ^ fp[child]) <= radius
                parts.join(asker[hit], child[hit])
    return order, parts.label


def _stars(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        mask, fp, rep = (np.concatenate(x) for x in zip(*got))
        order, label = local_components(mask.view(np.uint64), fp.view(np.uint64), radius)
        rep = rep[order]
        smallest = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, rep)
        root = smallest[label]
        linked = root != rep
        yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(root[linked])], names=["a", "b"])

    return run


# --- buckets and components as DataFrames -------------------------------------------------------------------------


def _parts(mask: int, pieces: int = 4) -> list[int]:
    """mask with each of so many parts of its free bits added."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // pieces for k in range(pieces + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(reps: DataFrame, scratch: Scratch, max_bucket: int, n_reps: int | None = None) -> DataFrame:
    """(mask, fp, rep): each fingerprint in all buckets that it has to be compared in; n_reps: how many there are."""
    masks, done = _parts(0), []
    rows = reps.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp", "rep")
    while True:
        key = F.col("fp").bitwiseAND(F.col("mask"))
        heavy = scratch.save(
            rows.groupBy("mask", key.alias("key")).count().where(F.col("count") > max_bucket).select("mask", "key"),
            n_reps if n_reps is None else n_reps * len(masks) // max_bucket,
        )
        n = heavy.count()
        if not n or len(masks) >= 4**5:
            done.append(rows)
            break
        hot = heavy.select(F.col("mask").alias("hot_mask"), F.col("key").alias("hot_key"))
        hot = F.broadcast(hot) if n <= 100_000 else hot
        same = (F.col("mask") == F.col("hot_mask")) & (key == F.col("hot_key"))
        done.append(rows.join(hot, same, "left_anti"))
        children = {m: _parts(m) for m in masks}
        split = F.create_map(*[x for m, c in children.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in c]))])
        rows = scratch.save(
            rows.join(hot, same, "left_semi").select(F.explode(split[F.col("mask")]).alias("mask"), "fp", "rep")
        )
        masks = [y for c in children.values() for y in c]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def star_components(edges: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """(a, b): each node of the edges (a, b) that is not its component's smallest, with the smallest as b.

    most: how many edges there are at most.

    Alternating large-star and small-star steps.  A hub's edges are never gathered: minima come from partial
    aggregates, and go back by joins of two stored tables, whose large partitions Spark splits.
    """
    e = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), most
    )
    before = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return e
        before, most = mark, 2 * mark[0]
        both = e.select("a", "b").union(e.select("b", "a"))
        low = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), most)
        large = scratch.save(
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), most
        )
        low2 = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), most)
        small = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.save(small.union(low2.select("a", F.col("m").alias("b"))).distinct(), most)
        for x in (e, low, large, low2):
            scratch.drop(x)
        e = new


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, max_bucket: int = 50_000, task_rows: int = 400_000
) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs.

    component_id is the smallest doc_id reachable over links of radius or fewer differing bits, itself included.
    A null text counts as empty; all texts without words have fingerprint 0 and link like any other.  A row with a null
    id gets its fingerprint and, if another row holds the same text or one at the radius, that component, else null;
    it makes no link itself.  Repeated rows give a row each; an empty table gives an empty result.

    task_rows: bucket rows that a task gets on average; it holds them (24 bytes each, and as much again for the tree).
    """
    if radius > 3:
        raise ValueError("four blocks find all pairs up to 3 differing bits only")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    prints = scratch.save(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), binary_text(text_col).alias("raw")).mapInArrow(
            _fingerprints, "doc_id long, fp long"
        )
    )
    reps = scratch.save(
        prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), prints.count()
    )
    n_reps = reps.count()
    dealt = _dealt(reps, scratch, max_bucket, n_reps)
    n_dealt = dealt.count()
    tasks = tasks_for(spark, n_dealt, task_rows)
    edges = dealt.repartition(tasks, "mask", F.col("fp").bitwiseAND(F.col("mask"))).mapInArrow(_stars(radius), "a long, b long")
    stars = star_components(edges, scratch, n_dealt)
    roots = stars.select(F.col("a").alias("rep"), F.col("b").alias("root"))
    known = scratch.save(
        reps.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id")), n_reps
    )
    return prints.join(known, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(col: str = "fp") -> "F.Column":
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """docs with one row of each component: that with the smallest id.

    Of several rows with that id one stays.  Rows with a null id cannot be told apart by it and all stay.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(simhash_components(docs, id_col, text_col, radius).where("doc_id is not null").select("doc_id", "component_id"), docs.count())
    n = found.count()
    losers = scratch.save(found.where("component_id <> doc_id").select("doc_id").distinct(), n)
    repeated = scratch.save(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), n // 2)
    kept = drop_ids(docs, losers, losers.count(), id_col)
    n = repeated.count()
    if not n:
        return kept
    names = docs.columns
    key = f"c{names.index(id_col)}"
    rows = kept.toDF(*[f"c{i}" for i in range(len(names))])
    again = sized_broadcast(repeated.toDF("again"), n, 16)
    once = rows.join(again, F.col(key) == F.col("again"), "left_semi").dropDuplicates([key])
    return drop_ids(kept, repeated, n, id_col).unionAll(once.toDF(*names))
