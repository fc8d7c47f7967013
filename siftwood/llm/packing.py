"""Best-fit packing of tokenised documents into fixed-length sequences, certified by bounds and repacked in rounds.

Texts are tokenised once; from then on only (document, piece, length, checksum) rows move.  Pieces of the full length
are sequences by themselves.  The others are dealt evenly over groups of a few thousand, and each group is packed by
best-fit decreasing.  Dual-feasible functions (the identity, the threshold functions and the rounding functions
floor((k+1)x)/k) give a lower bound on any packing of the group.  A group that meets its bound is certified: all it
puts up for exchange are its emptiest sequences.  A group with a gap puts up every sequence that isn't full.  What is
put up is dealt to fewer groups and packed again.  Rounds end when the total meets the bound over all pieces together,
or once all that is left has been packed in one group, or when a round of repacking saves nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm._shared import Scratch, tasks_for
from siftwood.llm.tokens import encoder
from siftwood.runtime import ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, settled boolean"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than capacity."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def _tokenised(capacity: int, end_id: int, json_path: str | None, ranks_path: str | None):
    def run(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
        coder = encoder(json_path, ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(coder.ids(text), np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def lower_bound(histogram: np.ndarray, capacity: int, roundings: int = 32) -> int:
    """The best bound of the dual-feasible functions on the bins for histogram[x] items of length x."""
    x = np.arange(capacity + 1)
    count = histogram.astype(np.int64)
    best = -(-int((count * x).sum()) // capacity)
    # thresholds t: items above capacity - t fill a bin, items below t count nothing, others their length
    below = np.concatenate(([0], np.cumsum(count * x)))
    number = np.concatenate(([0], np.cumsum(count)))
    t = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = below[capacity - t + 1] - below[t]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, roundings + 1):  # x if (k+1)x/capacity is whole, else floor((k+1)x/capacity) capacity / k
        parts, rest = np.divmod((k + 1) * x, capacity)
        weight = np.where(rest == 0, x * k, parts * capacity)  # times k
        best = max(best, -(-int((count * weight).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item.  Open bins lie in stacks by free space; a bit set finds the tightest that fits."""
    bins = np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_bits = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        above = free_bits >> need
        if above:
            free = need + (above & -above).bit_length() - 1
            b = open_[free].pop()
            if not open_[free]:
                free_bits &= ~(1 << free)
        else:
            free, b, made = capacity, made, made + 1
        left = free - need
        if left:
            open_[left].append(b)
            free_bits |= 1 << left
        bins[i] = b
    return bins


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, settled) of each item of one group."""
    bins = best_fit_decreasing(lengths, capacity)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    order = np.lexsort((-lengths, bins))
    ends = np.cumsum(lengths[order])
    first = np.concatenate(([0], np.cumsum(fill)[:-1]))
    offset = np.empty(len(lengths), np.int64)
    offset[order] = ends - lengths[order] - first[bins[order]]
    gap = len(fill) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    if gap:
        settled = fill == capacity
    else:  # certified: only the emptiest, and what lacks more than a 256th, can help others
        settled = fill >= capacity - capacity // 256
        settled[np.argmin(fill)] = fill.min() == capacity
    return bins, offset, settled[bins]


def _packed(capacity: int, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        group, length = rows.column("group").to_numpy(), rows.column("length").to_numpy()
        tie = [rows.column(c).to_numpy(zero_copy_only=False) for c in ("ids_crc32", "piece", "row")]
        order = np.lexsort((*tie, group))  # rows arrive in any order; the result must not depend on it
        rows, group, length = rows.take(pa.array(order)), group[order], length[order]
        edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() + [len(group)]
        for a, b in zip(edges, edges[1:]):
            bins, offset, settled = pack_group(length[a:b], capacity)
            sequence = (np.int64(round_) << 56) | (np.int64(group[a]) << 20) | bins
            part = rows.slice(a, b - a).select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield from pa.Table.from_arrays(
                [*part.columns, pa.array(sequence), pa.array(offset), pa.array(settled)],
                names=[*part.column_names, "sequence_id", "offset", "settled"],
            ).to_batches()

    return run


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    end_id: int = 0,
    group_pieces: int = 2048,
    max_rounds: int = 12,
    task_pieces: int = 1 << 19,
    id_col: str = "doc_id",
    text_col: str = "text",
    json_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece of each row of docs.

    A document is its text's ids and then end_id; a null or empty text is end_id alone.  Null ids and repeated rows are
    pieces like any other; other columns are not read.  No documents, no pieces.

    group_pieces: pieces that are packed together.  task_pieces: pieces that a task gets, in many groups (some 60 bytes
    each); so tasks grow with the pieces' bytes and not with the number of groups.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    pieces = scratch.save(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            _tokenised(capacity, end_id, json_path, ranks_path), PIECES
        )
    )
    # lengths are 1 to capacity, so this histogram has at most capacity rows
    counted = pieces.groupBy("length").count().collect()
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counted:
        histogram[row["length"]] = row["count"]
    bound = lower_bound(histogram, capacity)
    whole = int(histogram[capacity])
    left = int(histogram.sum()) - whole
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = [
        pieces.where(F.col("length") == capacity)
        .withColumn("sequence_id", -1 - F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
        .select(columns)
    ]
    todo, sequences, put_up = pieces.where(F.col("length") < capacity), whole, 0
    for round_ in range(1, max_rounds + 1):
        if not left:
            break
        groups = -(-left // group_pieces)
        row = F.monotonically_increasing_id()
        packed = scratch.save(
            todo.withColumn("row", row)
            .withColumn("group", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(groups)).cast("long"))
            .repartition(tasks_for(spark, left, task_pieces), "group")
            .mapInArrow(_packed(capacity, round_), PACKED)
        )
        # each sequence has one piece at its beginning
        made = packed.groupBy("settled").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("bins"))
        by = {r["settled"]: r for r in made.collect()}
        settled, open_ = (by[k]["bins"] if k in by else 0 for k in (True, False))
        total = sequences + settled + open_
        last = total <= bound or groups == 1 or round_ == max_rounds or (round_ > 1 and settled + open_ >= put_up and open_ == put_up)
        done.append((packed if last else packed.where("settled")).select(columns))
        if last:
            break
        sequences, put_up = sequences + settled, open_
        todo, left = packed.where("not settled").select("doc_id", "piece", "start", "length", "ids_crc32"), by[False]["n"] if False in by else 0
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
