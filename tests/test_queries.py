"""Every registered query outside the training-data package runs, and equals its SQL."""

import math

import duckdb
import pandas as pd
import pytest

from siftwood.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return repr(int(v)) if v == int(v) else repr(v)
    return str(v.tz_localize(None) if isinstance(v, pd.Timestamp) and v.tzinfo else v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, name):
    found = QUERIES[name](spark, small)
    told = pd.DataFrame([tuple(r) for r in found.collect()], columns=found.columns)
    if name not in SQL:
        assert len(told)
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    expected = db.execute(SQL[name]).df()
    assert sorted(told.columns) == sorted(expected.columns)
    assert rows(told) == rows(expected)


def test_entry_without_training_package(spark, small, monkeypatch):
    import importlib.util

    import __spark_entry__

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("siftwood.llm", "corpus_pipeline")) else find(n, *a))
    try:
        entry = importlib.reload(__spark_entry__)
        assert not entry.HAS_LLM and set(entry.queries()) == set(QUERIES) and entry.entry(spark).count() == 9
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
