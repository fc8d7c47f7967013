import pytest

from siftwood.llm.compression import Band, CompressionRules, compression_bands, line_repeats, repeat_words


def brute_repeat(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return sum(any(windows.count(windows[j]) > 1 for j in range(max(0, i - 2), min(i + 1, len(windows)))) for i in range(len(words)))


@pytest.mark.parametrize("text", ["", "a", "a b c", "a b c a b c", "a a a a", "x y z q x y z r y z q", "a b a b a b c"])
def test_repeat_words(text):
    words = text.encode().split()
    assert repeat_words(words) == brute_repeat(words)


def test_counts(spark, documents):
    text = "Ünï # <b>\nsame line\nsame line\n\n\n \n \nsame line "
    row = compression_bands(documents({1: text})).first()
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    assert (row.n_words, row.word_chars, row.n_symbols) == (len(words), sum(map(len, words)), 3)
    assert row.n_dup_lines == line_repeats(text.encode()) == 1  # the last has a blank more; lines without a word don't count
    assert row.base_failed and not row.kept


def test_bands_and_chunks(spark, documents):
    import random

    rng = random.Random(4)
    syllables = ["ta", "re", "mi", "no", "lu", "ke", "so", "vi", "da", "pe", "the", "ing", "est", "or", "an", "un"]
    signs = [chr(c) for c in range(33, 127)]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts = {
        1: prose(900),
        2: " ".join(f"buy {i} now" for i in range(900)),  # too regular
        3: " ".join("".join(rng.choice(signs) for _ in range(18)) for _ in range(900)),
        4: prose(3000) + " " + " ".join(f"row {i} of the same table" for i in range(6000)),
        5: prose(30),
    }
    rules = CompressionRules(bands=(Band(512, 1.6, 3.0), Band(65536, 1.6, 50.0)), chunk_band=(1.6, 3.4))
    found = {r.doc_id: r for r in compression_bands(documents(texts), rules).collect()}
    assert [found[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert (found[2].reason, found[4].reason) == ("repetitive", "repetitive_chunks")
    assert found[5].base_failed and found[5].reason is None
    strict = CompressionRules(bands=(Band(512, 1.6, 3.0),))
    assert compression_bands(documents({3: texts[3]}), strict).first().reason == "incompressible"


def test_short_random_text_goes(spark, documents):
    import random

    rng = random.Random(8)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = {}
    for n in (300, 400, 511, 512, 700, 1000, 1100, 1500, 2000, 2100, 3000):
        for most in (5, 8):
            words = " ".join("".join(rng.choice(signs) for _ in range(rng.randint(3, most))) for _ in range(n))
            texts[10 * n + most] = words[:n]
    found = compression_bands(documents(texts)).collect()
    assert {r.reason for r in found} == {"incompressible"} and not any(r.kept for r in found)
    assert all(not r.base_failed for r in found if r.doc_id % 10 == 5)  # so that only the ratio speaks against them


def test_clean_documents_stay(spark, small):
    folder = small.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    told = compression_bands(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert told[told.quality == 1].kept.mean() > 0.999
    assert told[told.quality == 0].kept.mean() < 0.6


def test_other_scripts(spark, documents):
    """The same prose in letters of one byte and of two gets the same verdict; a repeated phrase goes in any script."""
    import random

    rng = random.Random(6)
    letters = "eeeeeetttttaaaaoooiiinnnsssrrrhhhlldduuccmmffppggwwyybbvvk"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    cyrillic = {c: 0x430 + k for k, c in enumerate(range(97, 123))}
    texts = {n: prose(n) for n in (90, 200, 500, 2000, 8000)}
    texts |= {10 * n: t.translate(cyrillic) for n, t in texts.items()}
    texts |= {7: "купи это сейчас " * 300}
    found = {r.doc_id: r for r in compression_bands(documents(texts)).collect()}
    assert found[7].reason == "repetitive"
    assert {n: (found[n].reason, found[10 * n].reason) for n in (90, 200, 500, 2000, 8000)} == {n: (None, None) for n in (90, 200, 500, 2000, 8000)}
    plain = CompressionRules(wide_bytes=9.0)  # without the rule some of the longer ones would go
    assert any(r.reason for r in compression_bands(documents({k: t for k, t in texts.items() if k > 1000}), plain).collect())


def test_query_against_brute_force(spark, small):
    """Every column of the registered query, from plain Python over whole texts."""
    import re

    import zstandard

    from siftwood.llm.queries import op4_compression_bands

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rules = CompressionRules()
    found = op4_compression_bands(spark, small).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id]
        words, raw = re.findall(r"[^\x20\x09-\x0D]+", text), text.encode()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) else set()
        repeats = len({i + k for i, w in enumerate(windows) if w in twice for k in range(3)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats)
        assert r.base_failed == (len(words) < 50 or 100 * repeats > 50 * len(words))
        size = lambda x: len(zstandard.ZstdCompressor(level=rules.level).compress(x))
        wide = len(raw) / max(1, len(text))
        wide = wide if wide > rules.wide_bytes else 1
        band = max((b for b in rules.bands if len(raw) >= b.min_bytes), key=lambda b: b.min_bytes, default=None)
        bad = band and not band.lowest <= len(raw) / size(raw) <= wide * band.highest
        if len(raw) >= rules.chunk_bytes + rules.min_chunk_bytes:
            chunks = [raw[i : i + rules.chunk_bytes] for i in range(0, len(raw), rules.chunk_bytes)]
            ratios = [len(c) / size(c) for c in chunks if len(c) >= rules.min_chunk_bytes]
            assert r.n_chunks == len(ratios)
            for out in (sum(x < rules.chunk_band[0] for x in ratios), sum(x > wide * rules.chunk_band[1] for x in ratios)):
                bad = bad or out > rules.bad_chunk_share * len(ratios)
        assert r.kept == (not r.base_failed and not bad) and (r.reason is not None) == bool(bad)
