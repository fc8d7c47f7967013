import itertools
import time

import numpy as np
import pytest

from siftwood.llm import decontaminate as dc

#: The shortest items too are laid anywhere on a text.
ANY_LENGTH = dc.SeedRules(min_item=0)
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strange potions under an ancient oak tree"


def brute(docs, items, rules):
    """All alignments of all pairs, without seeds."""
    out = set()
    for d, text in docs:
        words = dc.tokens(text.encode())
        for i, item in items:
            other = dc.tokens(item.encode())
            for shift in range(-len(other), len(words)):
                pairs = [(k, k - shift) for k in range(max(0, shift), min(len(words), shift + len(other)))]
                eq = [words[a] == other[b] for a, b in pairs]
                n = len(eq)
                for a in range(n):
                    for b in range(n, a, -1):
                        if eq[a] and eq[b - 1] and 1000 * sum(eq[a:b]) >= 1000 * rules.min_identity * (b - a) and b - a >= min(rules.min_overlap, len(other)):
                            out.add((d, i))
    return out


def test_longest_stretch_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(400):
        eq = rng.random(rng.integers(1, 25)) < rng.choice([0.5, 0.8, 0.9])
        best = max((b - a for a in range(len(eq)) for b in range(a + 1, len(eq) + 1) if eq[a] and eq[b - 1] and 1000 * eq[a:b].sum() >= 800 * (b - a)), default=0)
        a, b = dc.longest_stretch(eq, 0.8)
        assert b - a == best


def test_substitutions_case_and_punctuation(spark, documents):
    words = ITEM.split()
    swapped = list(words)
    for k in (3, 9, 16):
        swapped[k] = "zzz"
    docs = {
        1: "before " + ITEM + " after",
        2: "Some words. " + " ".join(swapped).upper() + "! And more, of course.",
        3: "a text about wizards and an ancient oak tree that nobody copied",
        4: ", ".join(words[:8]),
    }
    benchmark = spark.createDataFrame([(7, ITEM), (8, "tiny item")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in dc.find_leaks(documents(docs), benchmark).collect()}
    assert set(found) == {(1, 7), (2, 7)} == brute(docs.items(), [(7, ITEM), (8, "tiny item")], dc.SeedRules())
    assert (found[1, 7].doc_start, found[1, 7].item_start, found[1, 7].overlap, found[1, 7].matched) == (1, 0, 21, 21)
    assert (found[2, 7].overlap, found[2, 7].matched) == (21, 18)
    assert {r.doc_id for r in dc.remove_leaks(documents(docs), benchmark).collect()} == {3, 4}


def test_short_items_match_whole(spark, documents):
    benchmark = spark.createDataFrame([(1, "purple monkey dishwasher")], "item_id long, text string")
    found = dc.find_leaks(documents({1: "a purple monkey dishwasher", 2: "purple monkey"}), benchmark, ANY_LENGTH).collect()
    assert [(r.doc_id, r.overlap) for r in found] == [(1, 3)]


def test_everyday_phrases_match_whole_lines_only(spark, documents):
    benchmark = spark.createDataFrame([(1, "the"), (2, "what is the answer"), (3, "one two three four five six seven eight")], "item_id long, text string")
    docs = documents({
        1: "the cat sat on the mat and asked what is the answer to that",
        2: "Question:\nWhat is the answer?\nNobody knows.",
        3: "count one two three four five six seven eight nine",
        4: "The\nend",
    })
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, benchmark).collect()} == {(2, 2), (3, 3), (4, 1)}
    assert {r.doc_id for r in dc.remove_leaks(docs, benchmark).collect()} == {1}


def test_stretches_of_many_diagonals_at_once():
    rng = np.random.default_rng(0)
    for _ in range(200):
        equal = rng.random((6, rng.integers(1, 30))) < rng.choice([0.3, 0.5, 0.8, 0.9])
        a, b = dc.longest_stretches(equal, 0.8)
        for r in range(6):
            one = dc.longest_stretch(equal[r], 0.8)
            assert (a[r], b[r]) == one or a[r] == b[r] and one == (0, 0)


@pytest.mark.parametrize("dense", [0, 1 << 40])
def test_shifted_and_paired_seeds_find_the_same(monkeypatch, dense):
    rng = np.random.default_rng(3)
    items = [(k, " ".join(rng.choice(["na", "ba", "da"], rng.integers(21, 60))).encode()) for k in range(4)] + [(9, b"na " * 80)]
    texts = [" ".join(rng.choice(["na", "ba", "da", "x"], rng.integers(0, 400))).encode() for _ in range(6)] + [b"na " * 300, items[2][1] * 3]
    wanted = {}
    for t, raw in enumerate(texts):
        for k, item in items:
            words, other = dc.tokens(raw), dc.tokens(item)
            for d in range(-len(other), len(words)):
                equal = np.array([0 <= d + i < len(words) and words[d + i] == w for i, w in enumerate(other)])
                i, j = dc.longest_stretch(equal, 0.8)
                if j - i >= 20:
                    found = (j - i, int(equal[i:j].sum()), -(d + i))
                    wanted[t, k] = max(wanted.get((t, k), found), found)
    monkeypatch.setattr(dc, "DENSE", dense)
    told = {(t, k): (v[2], v[3], -v[0]) for t, k, v in dc.Searcher(dc.SeedIndex(items, dc.SeedRules())).overlaps(texts)}
    # seeds may miss an overlap; what they find is the best one's length or a shorter one's
    assert set(told) <= set(wanted) and len(told) >= 0.95 * len(wanted)
    assert sum(told[x] == wanted[x] for x in told) >= 0.95 * len(told)
    assert told[6, 9] == wanted[6, 9] == (80, 80, 0)


def test_one_repeated_word_ends_in_seconds():
    for item in (b"na " * 2000, b"na " * 1000 + b"xx " * 1000):
        begun = time.time()
        index = dc.SeedIndex([(1, item)], dc.SeedRules())
        [(_, _, found)] = dc.Searcher(index).overlaps([b"na " * 60_000])
        assert found[2] >= 1000 and time.time() - begun < 30


def test_masks_hit_the_allowed_substitutions():
    """Of all ways to substitute a fifth of 20 to 25 tokens, seeds find 0.99; up to 20 tokens pieces find them all."""
    for n in range(20, 26):
        rows = []
        for mask in dc.MASKS:
            at = dc.offsets(mask)
            for k in range(n - int(at[-1])):
                row = np.zeros(n, np.int32)
                row[at + k] = 1
                rows.append(row)
        ways = np.array(list(itertools.combinations(range(n), n // 5)))
        bad = np.zeros((len(ways), n), np.int32)
        bad[np.arange(len(ways))[:, None], ways] = 1
        assert ((bad @ np.array(rows).T) == 0).any(axis=1).mean() >= 0.99
    for n in range(1, 21):
        need = dc.needed(n, dc.SeedRules())
        cuts = dc.pieces(n, need)
        assert all(any(not set(range(a, b)) & set(bad) for a, b in cuts) for bad in itertools.combinations(range(n), n - need))


def test_the_query_against_brute_force(spark, tmp_path):
    """The registered query over whole tables, held against all alignments of all pairs."""
    from siftwood.llm.queries import queries

    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary, n, replace=False))) for i, n in enumerate((9, 15, 20, 24, 40))]
    docs = {}
    for d in range(60):
        own = items[d % 5][1].split()
        for k in rng.choice(len(own), len(own) // 6, replace=False):
            own[k] = "zzz"
        docs[d] = " ".join([*rng.choice(vocabulary, 15), *(own if d % 3 else []), *rng.choice(vocabulary, 15)])
    spark.createDataFrame([(d, x, "en", "s", len(x)) for d, x in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries()["op1_spaced_seed_decontamination"](spark, str(tmp_path)).collect()
    short, long = [x for x in items if len(x[1].split()) <= 20], [x for x in items if len(x[1].split()) > 20]
    wanted = brute_whole(docs.items(), short) | brute(docs.items(), long, dc.SeedRules())
    assert {(r.doc_id, r.item_id) for r in found} == wanted and len(wanted) == 40


def brute_whole(docs, items, share=0.8):
    """Short items laid on the text at every place, counted by the tokens that agree; texts end anywhere."""
    out = set()
    for d, text in docs:
        words = dc.tokens(text.encode())
        for i, item in items:
            other = dc.tokens(item.encode())
            for at in range(-len(other), len(words)):
                same = sum(0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(other))
                if same and 1000 * same >= 1000 * share * len(other):
                    out.add((d, i))
    return out


def test_short_items_by_their_identity(spark, documents):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(n, " ".join(rng.choice(vocabulary, n, replace=False))) for n in range(1, 21)]
    docs, leaks = {}, set()
    for n, item in items:
        words = item.split()
        for case in range(14):
            own, changed = list(words), n // 5 + case % 2  # one change more than allowed in every other
            if case < 2:  # ends substituted
                for k in [*range(0, n, max(1, n - 1)), *range(1, n)][:changed]:
                    own[k] = "zzz"
            elif case < 4:  # first words missing, at the text's very start
                own = own[changed:]
            elif case < 6:  # last words missing, at the text's very end
                own = own[: n - changed]
            else:
                for k in rng.choice(n, min(n, changed), replace=False):
                    own[k] = "zzz"
            before, after = ([] if case in (2, 3) else ["qqq"] * 3), ([] if case in (4, 5) else ["qqq"] * 3)
            docs[100 * n + case] = " ".join([*before, *own, *after])
            leaks |= set() if case % 2 else {(100 * n + case, n)}
    found = dc.find_leaks(documents(docs), spark.createDataFrame(items, "item_id long, text string"), ANY_LENGTH)
    told = {(r.doc_id, r.item_id) for r in found.collect()}
    assert told == brute_whole(docs.items(), items) and leaks <= told
    assert {r.doc_id for r in dc.remove_leaks(documents(docs), spark.createDataFrame(items, "item_id long, text string"), ANY_LENGTH).collect()} == set(docs) - {d for d, _ in told}


@pytest.mark.parametrize("max_seeds", [300, 2_000_000])
def test_blocks_find_the_same(spark, documents, max_seeds):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, 30))) for i in range(5)]
    docs = {d: " ".join([*rng.choice(vocabulary, 20), *(items[d % 5][1].split() if d % 2 else []), *rng.choice(vocabulary, 20)]) for d in range(12)}
    rules = dc.SeedRules(max_seeds=max_seeds)
    found = dc.find_leaks(documents(docs), spark.createDataFrame(items, "item_id long, text string"), rules)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(docs.items(), items, rules) == {(d, d % 5) for d in docs if d % 2}
