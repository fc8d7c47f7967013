import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table: texts by id, or (id, text) pairs where ids repeat or are null."""

    def make(texts, extra=False):
        pairs = texts.items() if isinstance(texts, dict) else texts
        rows = [(i, t, None, "src0", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        if extra:  # names that an operator might use itself
            from pyspark.sql import functions as F

            for name in ("raw", "fp", "score", "row", "group", "id", "words", "c0", "component_id", "text_hash", "added", "a.b", "__id", "__added", "__drop_id", "found_id", "gone", "again"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (None, "one two three four five six"), (4, "same words here again"), (4, "same words here again"), (5, LONG), (6, "ünïcödé 🙂 text   ok")]
