import numpy as np
import pytest
import xxhash

from siftwood.llm import simhash
from siftwood.llm.queries import op10_simhash


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "a b c d a b c", "É É é É É", "x\x0by\x0cz w", "a b c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(4096, dtype=np.uint64)
    assert np.array_equal(simhash.gray_rank(n ^ (n >> np.uint64(1))), n)


def near(rng, n, groups):
    """Fingerprints of which many differ in few bits."""
    heads = rng.integers(0, 1 << 63, groups, dtype=np.uint64)
    out = heads[rng.integers(0, groups, n)]
    for _ in range(3):
        flip = rng.random(n) < 0.5
        out = np.where(flip, out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), out)
    return np.unique(out)


def brute_components(fp, radius=3):
    parts = simhash.Components(len(fp))
    for i in range(len(fp)):
        hit = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) + i + 1
        parts.join(np.full(len(hit), i), hit)
    return parts.label


@pytest.mark.parametrize("groups", [1, 7, 300])
def test_tree_against_brute_force(groups):
    fp = near(np.random.default_rng(groups), 1500, groups)
    order, label = simhash.local_components(np.zeros(len(fp), np.uint64), fp, frontier=5000)
    back = np.empty(len(fp), int)
    back[order] = label
    expected = brute_components(fp)
    assert len(set(back)) == len(set(expected)) == len(set(zip(back, expected)))


@pytest.mark.parametrize("max_bucket", [4, 50_000])
def test_components_against_brute_force(spark, max_bucket):
    """The whole way from fingerprints, with buckets dealt anew and not."""
    fp = near(np.random.default_rng(9), 900, 60)
    scratch = simhash.Scratch(spark)
    reps = spark.createDataFrame([(int(x), i) for i, x in enumerate(fp.view(np.int64))], "fp long, rep long")
    dealt = simhash._dealt(reps, scratch, max_bucket)
    edges = dealt.repartition(3, "mask", simhash.F.col("fp").bitwiseAND(simhash.F.col("mask"))).mapInArrow(simhash._stars(3), "a long, b long")
    root = {r.a: r.b for r in simhash.star_components(edges, scratch).collect()}
    expected = brute_components(fp)
    assert [root.get(i, i) for i in range(len(fp))] == expected.tolist()


def test_star_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = {r.a: r.b for r in simhash.star_components(spark.createDataFrame(edges, "a long, b long"), simhash.Scratch(spark)).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)}


def test_query_against_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {r.doc_id: r for r in op10_simhash(spark, small).collect()}
    ids = sorted(docs)
    fp = np.array([slow_fingerprint(docs[i]) for i in ids], np.uint64)
    label = brute_components(fp)
    assert [found[i].fingerprint for i in ids] == [f"{x:016x}" for x in fp.tolist()]
    assert [found[i].component_id for i in ids] == [ids[k] for k in label]


def test_tasks_grow_with_the_dealt_rows(spark, documents, monkeypatch):
    dealt = []
    repartition = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, n, *c: dealt.append(n) or repartition(self, n, *c))
    docs = documents({i: f"w{i} x{i // 2} y{i // 3} same end of it" for i in range(200)})
    whole = {(r.doc_id, r.fp, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert dealt == [1]
    split = {(r.doc_id, r.fp, r.component_id) for r in simhash.simhash_components(docs, task_rows=50).collect()}
    assert dealt[1] >= 4 * len({fp for _, fp, _ in whole}) // 50 and split == whole
