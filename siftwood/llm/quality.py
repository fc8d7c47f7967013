"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Words and word heads, binned statistics of the whole text (length, symbols, capitals, repeats, lines) and binned
metadata numbers are features of one machine.  Its low-rank pairwise part can tell, say, a list of short lines with
many numbers from a table of contents.  Scoring takes time linear in the features by the sum-of-squares identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm import fm, text_features
from siftwood.llm._shared import filter_rows
from siftwood.runtime import ship

THRESHOLD = 0.3
MAX_ROWS = 20_000
#: Numbers about a document that may enter its score; labels, language, source and id never do.
METADATA = ("n_chars",)
SETTINGS = fm.FMSettings(keep=1024, rate=0.3, epochs=8)


def learn_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, settings: fm.FMSettings = SETTINGS, metadata: tuple[str, ...] = METADATA, id_col: str = "doc_id", text_col: str = "text"
) -> fm.FMModel:
    """A model from at most max_rows labelled documents outside the held-out fifth."""
    return text_features.learn(docs, labels, label_col, text_features.words_and_structure, settings, max_rows, id_col, text_col, metadata)


def score_quality(
    docs: DataFrame, model: fm.FMModel, threshold: float = THRESHOLD, metadata: tuple[str, ...] = METADATA, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of docs.

    A null text counts as empty, a null or missing metadata number makes no feature.  Null ids are scored and not held out;
    repeated rows are scored each; other columns are not read; without usable labels every text scores alike.  An empty
    table gives an empty result.
    """
    found = text_features.score(docs, model, text_features.words_and_structure, id_col, text_col, metadata)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _good(sent, threshold: float, metadata: tuple[str, ...]):
    def decide():
        model = sent.value

        def keep(batch):
            return (text_features.scores_of(model, batch, text_features.words_and_structure, metadata) >= threshold).tolist()

        return keep

    return decide


def keep_good(docs: DataFrame, model: fm.FMModel, threshold: float = THRESHOLD, metadata: tuple[str, ...] = METADATA, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, with a score of threshold or more."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, text_col, _good(sent, threshold, metadata), needs=metadata)
