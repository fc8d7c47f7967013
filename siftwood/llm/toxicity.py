"""Toxicity by a factorisation machine over hashed terms.

A linear model adds up the weights of a text's terms; the machine also learns a short vector for each term, and each
pair of terms adds the product of their vectors: an insult beside a mention of a group can count for more than both
alone, and a harmless companion can take an insult's weight away.  Terms are words and word heads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm import fm, text_features

THRESHOLD = 0.5
MAX_ROWS = 20_000
SETTINGS = fm.FMSettings(keep=1024, rate=0.3, epochs=8)


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS, settings: fm.FMSettings = SETTINGS, id_col: str = "doc_id", text_col: str = "text"
) -> fm.FMModel:
    """A model from at most max_rows labelled documents outside the held-out fifth."""
    return text_features.learn(docs, labels, label_col, text_features.words_only, settings, max_rows, id_col, text_col)


def score_toxicity(docs: DataFrame, model: fm.FMModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of docs.

    A null text counts as empty; a text without words has the score of the model's bias.  Null ids are scored and not
    held out; repeated rows are scored each; other columns are not read; without usable labels every text scores alike.
    An empty table gives an empty result.
    """
    found = text_features.score(docs, model, text_features.words_only, id_col, text_col)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
