"""Hashed features of a text's UTF-8 bytes, and the learning of a factorisation machine from labelled documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm import fm
from siftwood.llm._shared import ALNUM, binary_text, sized_broadcast
from siftwood.runtime import ship

#: Bytes of a word's head that make a feature of their own, so that forms of one stem share what is learnt.
STEM = 6
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"


def words_and_stems(raw: bytes, dimensions: int) -> set[int]:
    """A feature for each distinct word (lower case, without punctuation) and for the head of each longer one."""
    words = set(raw.translate(ALNUM).split())
    found = {crc32(w) % dimensions for w in words}
    found.update({crc32(s, 1) % dimensions for s in {w[:STEM] for w in words if len(w) > STEM}})
    return found


def structure(raw: bytes, extra: tuple = ()) -> dict[str, float]:
    """Statistics of a whole text: its length, what it consists of, and how much of it repeats.

    extra: (name, number) pairs of metadata; a null number makes no feature.
    """
    n = len(raw)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    counts = Counter(words)
    share = lambda chars: (n - len(raw.translate(None, chars))) / max(n, 1)
    letters = share(LETTERS)
    out = {
        "bytes": log2(n + 1),
        "words": log2(len(words) + 1),
        "word_length": log2(n / max(len(words), 1) + 1),
        "symbols": share(SYMBOLS),
        "bangs": share(b"!?"),
        "upper": share(UPPER) / max(letters, 1e-9),
        "digits": share(DIGITS),
        "points": share(b".,;:"),
        "bars": share(b"|"),
        "distinct": len(counts) / max(len(words), 1),
        "top_word": max(counts.values(), default=0) / max(len(words), 1),
        "same_lines": 1 - len(set(lines)) / max(len(lines), 1),
        "line_length": log2(n / max(len(lines), 1) + 1),
        "runs": sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1),
    }
    return out | {f"meta:{k}": v for k, v in extra if v is not None}


#: Steps of a statistic that make one feature: sizes go by half powers of two, shares by a rising scale.
SIZES = {"bytes", "words", "word_length", "line_length"}


def binned(statistics: dict[str, float], dimensions: int) -> set[int]:
    found = set()
    for name, value in statistics.items():
        if name in SIZES or name.startswith("meta:"):
            step = int(2 * value)
        else:
            step = int(4 * log2(1 + 256 * max(value, 0.0)))
        found.add(crc32(f"{name}={step}".encode(), 2) % dimensions)
    return found


Featuriser = Callable[[bytes, tuple, int], set]


def words_only(raw: bytes, extra: tuple, dimensions: int) -> set[int]:
    return words_and_stems(raw, dimensions)


def words_and_structure(raw: bytes, extra: tuple, dimensions: int) -> set[int]:
    return words_and_stems(raw, dimensions) | binned(structure(raw, extra), dimensions)


def _numbers(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[tuple]:
    """For each row: (name, log2 of 1 + the number) of each metadata column."""
    if not names:
        return [()] * batch.num_rows
    columns = [batch.column(n).to_pylist() for n in names]
    return [tuple((k, None if v is None else log2(1 + max(v, 0.0))) for k, v in zip(names, row)) for row in zip(*columns)]


def rows_of(batch: pa.RecordBatch, featurise: Featuriser, dimensions: int, metadata: tuple[str, ...]) -> list[np.ndarray]:
    """The feature numbers of each row of a batch with columns raw and those of metadata."""
    return [
        np.fromiter(featurise(raw, extra, dimensions), np.int32)
        for raw, extra in zip(batch.column("raw").to_pylist(), _numbers(batch, metadata))
    ]


def scores_of(model: fm.FMModel, batch: pa.RecordBatch, featurise: Featuriser, metadata: tuple[str, ...]) -> np.ndarray:
    rows = rows_of(batch, featurise, model.settings.dimensions, metadata)
    return model.score(np.concatenate(rows), np.array([len(r) for r in rows]))


def _features_of(featurise: Featuriser, dimensions: int, metadata: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                packed = [np.sort(r).tobytes() for r in rows_of(part, featurise, dimensions, metadata)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("y"), pa.array(packed, pa.binary())], names=["id", "y", "features"]
                )

    return run


def _scored(sent, featurise: Featuriser, metadata: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                score = scores_of(sent.value, part, featurise, metadata)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score)], names=["id", "score"])

    return run


def _inputs(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...], *more) -> DataFrame:
    numbers = [(F.col(m) if m in docs.columns else F.lit(None)).cast("double").alias(m) for m in metadata]
    return docs.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col).alias("raw"), *numbers, *more)


def held_out(id_col) -> "F.Column":
    """The fifth of the ids whose labels no model may see: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    featurise: Featuriser,
    settings: fm.FMSettings,
    max_rows: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: tuple[str, ...] = (),
) -> fm.FMModel:
    """Fits a model to at most max_rows labelled documents, chosen by a hash of the id among those not held out.

    Label rows with a null id or label are left out; of an id with several labels the largest counts; of several
    documents with one id one is used.  max_rows bounds what the driver holds: the feature numbers of so many texts.
    """
    ship(docs.sparkSession)
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).cast("long").alias("label_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(max_rows)
    )
    rows = _inputs(docs, id_col, text_col, metadata).join(sized_broadcast(chosen, max_rows, 32), F.col("id") == F.col("label_id")).drop("label_id")
    found = (
        rows.mapInArrow(_features_of(featurise, settings.dimensions, metadata), "id long, y int, features binary")
        .groupBy("id")
        .agg(F.first("y").alias("y"), F.min("features").alias("features"))
        .collect()
    )
    found.sort(key=lambda r: r["id"])
    features = [np.frombuffer(r["features"], np.int32) for r in found]
    return fm.train(features, np.array([r["y"] > 0 for r in found], float), settings)


def score(
    docs: DataFrame,
    model: fm.FMModel,
    featurise: Featuriser,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, held_out, score): one row for each row of docs, without a shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # its size is fixed by the hash space and the rank
    scored = _inputs(docs, id_col, text_col, metadata).mapInArrow(_scored(sent, featurise, metadata), "id long, score double")
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score")
