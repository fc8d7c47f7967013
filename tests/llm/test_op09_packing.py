import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwood.llm import packing
from siftwood.llm.tokens import encoder


@given(st.lists(st.integers(1, 60), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_groups_are_packed_within_bounds(lengths):
    lengths = np.array(lengths)
    bins, offset, settled = packing.pack_group(lengths, 60)
    low = packing.lower_bound(np.bincount(lengths, minlength=61), 60)
    assert low <= len(set(bins)) <= -(-11 * low // 9) + 1
    for b in set(bins):
        at = 0
        for o, n in sorted(zip(offset[bins == b], lengths[bins == b])):
            assert o == at
            at += n
        assert at <= 60


def optimum(lengths, capacity):
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                bins[i] += lengths[k]
                place(k + 1, bins)
                bins[i] -= lengths[k]
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_bound_never_exceeds_the_optimum(lengths):
    assert packing.lower_bound(np.bincount(lengths, minlength=21), 20) <= optimum(lengths, 20)


def test_bound_beats_the_sum():
    assert packing.lower_bound(np.bincount([11, 11, 11], minlength=21), 20) == 3  # the sum needs 2
    assert packing.lower_bound(np.bincount([7] * 6, minlength=21), 20) == 3


@pytest.mark.parametrize("n, pieces", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (20, [(0, 4), (4, 8), (12, 8)])])
def test_cut(n, pieces):
    assert packing.cut(n, 8) == pieces


def check(found, texts, capacity):
    """Every piece is in place, every document whole; the number of sequences."""
    code = encoder()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, text in texts.items():
        ids = np.append(code.ids(text), 0).astype("<u4")
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in pieces] == packing.cut(len(ids), capacity)
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("group_pieces", [16, 2048])
def test_round_trip(spark, documents, group_pieces):
    texts = {1: None, 2: "", 3: "a few words", **{k: f"text {k} " * (k % 50) for k in range(4, 60)}}
    found = packing.pack_documents(documents(texts), capacity=64, group_pieces=group_pieces).collect()
    n = check(found, texts, 64)
    assert n <= sum(r.length for r in found) / 64 * 1.08 + 1
    again = packing.pack_documents(documents(texts), capacity=64, group_pieces=group_pieces).collect()
    pieces = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces(again) == pieces(found)


def test_query_round_trip(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = packing.pack_documents(spark.read.parquet(f"{small}/documents.parquet")).collect()
    n = check(found, texts, 2048)
    assert n <= -(-sum(r.length for r in found) // 2048) + 1


def test_fast_ids_are_the_library_s():
    """Every character below U+0250 in several surroundings, and texts beyond, give the ids of the tokenizers library."""
    code = encoder()
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f" {c}", f"{c} ", f"1{c}{c}2", f"\n{c}\n", f"x  {c}", f"{c}'s"):
            assert np.array_equal(code.ids(text), code.exact(text)), repr(text)
    for text in ("漢字 emoji 🙂 ok", "a b", "<|endoftext|>", "don't  stop\n\n now"):
        assert np.array_equal(code.ids(text), code.exact(text))


def test_tasks_grow_with_pieces_and_not_with_groups(spark, documents, monkeypatch):
    """A small limit of pieces for a task gives as many more tasks; what is packed stays as good."""
    dealt = []
    repartition = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, n, *c: dealt.append(n) or repartition(self, n, *c))
    docs = documents({i: " word" * (i % 97 + 1) for i in range(600)})
    for limit, most in ((1 << 19, spark.sparkContext.defaultParallelism), (100, 6)):
        dealt.clear()
        out = packing.pack_documents(docs, capacity=128, group_pieces=20, task_pieces=limit).collect()
        assert max(dealt) <= most and sum(r.length for r in out) == sum(i % 97 + 2 for i in range(600))
        assert len({r.sequence_id for r in out}) <= 1.02 * sum(r.length for r in out) / 128 + 1
    assert dealt[0] == 6  # 600 pieces by 100, whereas the groups are 30
