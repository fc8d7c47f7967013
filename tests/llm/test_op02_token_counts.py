import pytest

from siftwood.llm import token_counts as tc
from siftwood.llm.queries import op2_token_rollup


@pytest.fixture
def rollup(spark, tmp_path):
    return tc.TokenRollup(spark, str(tmp_path / "rollup"))


def rows(spark, *values):
    return spark.createDataFrame(list(values), tc.SCHEMA)


def totals(rollup):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals().collect()}


def test_commits_are_idempotent_and_signed(spark, rollup):
    first = rows(spark, ("a", "en", "v", 1, 10, 20), ("a", "en", "v", 1, 5, 6), (None, None, "v", 1, 1, 1))
    assert totals(rollup) == {}
    assert rollup.commit("load", first) and not rollup.commit("load", first)
    assert totals(rollup) == {("a", "en"): (2, 15, 26), (None, None): (1, 1, 1)}
    revision = rows(spark, ("a", "en", "v", -1, -5, -6), ("a", "en", "v", 1, 8, 9))  # the old size out, the new one in
    assert rollup.commit("revise", revision)
    assert rollup.commit("delete", rows(spark, (None, None, "v", -1, -1, -1)))
    assert rollup.commit("nothing", rows(spark))
    assert totals(rollup) == {("a", "en"): (2, 18, 29)}


def test_compaction_keeps_totals_and_ids(spark, rollup):
    for k in range(4):
        rollup.commit(f"b{k}", rows(spark, ("a", "en", "v", 1, k, k)))
        if k == 2:
            rollup.compact()
    rollup.compact()
    assert len(rollup._names()) == 1
    assert totals(rollup) == {("a", "en"): (4, 6, 6)}
    assert not rollup.commit("b0", rows(spark, ("a", "en", "v", 1, 99, 99))) and totals(rollup) == {("a", "en"): (4, 6, 6)}


def test_an_unfinished_fold_does_not_count(spark, rollup):
    rollup.commit("x", rows(spark, ("a", "en", "v", 1, 1, 1)))
    rollup.commit("y", rows(spark, ("a", "en", "v", 1, 1, 1)))
    rename = rollup._fs.rename
    names = rollup._names()
    rollup.compact()
    fold = rollup._names()[0]
    rename(rollup._at(f"batches/{fold}"), rollup._at(f"staged/{fold}"))  # as if the last step had not been taken ...
    assert totals(rollup) == {} and fold not in names
    rename(rollup._at(f"staged/{fold}"), rollup._at(f"batches/{fold}"))  # ... and then was
    assert totals(rollup) == {("a", "en"): (2, 2, 2)}


def test_query_against_brute_force(spark, small):
    import public_tokenizers

    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas().sort_values("doc_id")
    once = docs.drop_duplicates("text")
    shorter = once.assign(text=["\n".join(dict.fromkeys(t.split("\n"))) for t in once.text])
    assert (shorter.text != once.text).any() and len(once) < len(docs)  # so that batches of both kinds have rows
    expected = {}
    for version, file in tc.TOKENIZERS.items():
        encode = tc._encoding(public_tokenizers.path(file)).encode_ordinary
        for state, rows_ in (("loaded", docs), ("final", shorter)):
            for r in rows_.itertuples():
                key = (state, r.source, r.lang, version)
                n, tokens, chars = expected.get(key, (0, 0, 0))
                expected[key] = (n + 1, tokens + len(encode(r.text)), chars + len(r.text))
    found = {(r.state, r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in op2_token_rollup(spark, small).collect()}
    assert found == expected


def test_of_two_drivers_one_commits(spark, rollup):
    other = tc.TokenRollup(spark, rollup.path)
    other.committed = lambda batch_id: False  # it looked before the first one was through
    assert rollup.commit("x", rows(spark, ("a", "en", "v", 1, 1, 1)))
    assert not other.commit("x", rows(spark, ("a", "en", "v", 1, 1, 1)))
    assert totals(rollup) == {("a", "en"): (1, 1, 1)}
    assert not list(rollup._fs.listStatus(rollup._at("staged")))
