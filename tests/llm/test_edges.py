"""Each operator on nulls, empty and very long texts, repeated rows, empty tables, and columns with clashing names."""

import pytest

from siftwood.llm import chat, compression, decontaminate, licenses, packing, pii, quality, simhash, token_counts, toxicity
from tests.llm.conftest import EDGE


def labels(spark, rows=((10, 1, 0), (11, 0, 1), (12, 1, 0), (13, 0, 1), (None, 1, 1), (14, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items(spark, rows=((1, "a benchmark passage of some length that nobody else would write like this at all"), (2, None), (None, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "compression": lambda s, d: compression.compression_bands(d),
    "simhash": lambda s, d: simhash.simhash_components(d),
    "packing": lambda s, d: packing.pack_documents(d),
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "pii": lambda s, d: pii.find_spans(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, toxicity.learn_toxicity(d, labels(s))),
    "quality": lambda s, d: quality.score_quality(d, quality.learn_quality(d, labels(s))),
    "tokens": lambda s, d: token_counts.count_tokens(d, ["doc_id", "source", "lang"]),
}
ROWS = {"tokens": 2}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("extra", [False, True])
def test_a_row_for_each_row(spark, documents, name, extra):
    rows = OPERATORS[name](spark, documents(EDGE, extra)).collect()
    if name == "packing":
        rows = [r for r in rows if r.piece == 0]
    ids = sorted((r.doc_id for r in rows), key=str)
    assert ids == sorted([i for i, _ in EDGE] * ROWS.get(name, 1), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, documents, name):
    assert OPERATORS[name](spark, documents({})).count() == 0


def test_stages_keep_columns_and_rows(spark, documents):
    docs = documents(EDGE, extra=True)
    model = quality.learn_quality(docs, labels(spark))
    for out in (quality.keep_good(docs, model, threshold=0.0), decontaminate.remove_leaks(docs, items(spark)), pii.mask_documents(docs)):
        assert out.columns == docs.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    empty = documents({}, extra=True)
    for out in (quality.keep_good(empty, model), decontaminate.remove_leaks(empty, items(spark)), pii.mask_documents(empty), simhash.keep_one_each(empty)):
        assert out.columns == docs.columns and out.count() == 0


def test_one_of_each_component(spark, documents):
    kept = simhash.keep_one_each(documents(EDGE, extra=True))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, None, 4, 5, 6], key=str)  # 2 and 3 have no word, as 1


def test_decontamination_edges(spark, documents):
    docs = documents(EDGE)
    assert decontaminate.find_leaks(docs, items(spark)).count() == 0
    assert decontaminate.find_leaks(docs, items(spark, ())).count() == 0
    assert decontaminate.remove_leaks(docs, items(spark, ())).count() == len(EDGE)


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, rendered string, h1 string"
    rows = [(None, 0, "user", "x", "r", "h"), (1, 0, None, None, "r", "h"), (2, 0, "user", "", "r", "h"), (2, None, "user", None, "r", "h"), (3, 0, "user", "a", "r", "h"), (3, 0, "user", "a", "r", "h")]
    out = chat.format_chats(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    assert {(r.conv_id, r.n_turns) for r in out} == {(None, None), (1, 1), (2, 2), (3, 2)}
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_training_needs_no_labels(spark, documents):
    docs = documents(EDGE)
    scores = {r.score for r in toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, labels(spark, ()))).collect()}
    assert scores == {0.5}
