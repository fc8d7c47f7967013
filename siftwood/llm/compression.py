"""Quality rules by compression bands.

Every text is compressed by zstandard twice over: as a whole, and in fixed chunks.  The ratio (raw bytes by compressed
bytes) of natural prose lies in a band that depends on how much text the compressor saw: short inputs carry the frame's
overhead, long ones profit from a larger window.  A document is rejected when its whole-text ratio leaves the band of
its length class (too high: repetitive; too low: incompressible), or when more than a given share of its chunks do.

Scripts of several bytes a character repeat their lead bytes, which alone raises the ratio of ordinary prose by about
as much; so the upper limits of a text above wide_bytes bytes a code point are multiplied by its bytes a code point.

The operator is one pass without a shuffle: a Python worker sees a slice of an Arrow batch at a time, so memory is
bounded by the batch and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.llm._shared import WHITE, binary_text
from siftwood.runtime import ship

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))  # UTF-8's bytes that begin no code point
NOT_IN_WORDS = WHITE + CONTINUATION


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least min_bytes bytes (and below the next band's min_bytes)."""

    min_bytes: int
    lowest: float
    highest: float


@dataclass(frozen=True)
class CompressionRules:
    """Parameters of the method.

    bands: limits on the whole text's ratio by length; texts below the first band's min_bytes get no ratio verdict.
    chunk_band: limits on the ratio of a chunk of chunk_bytes.  A last chunk below min_chunk_bytes is not judged, nor is
    the one chunk of a text below chunk_bytes + min_chunk_bytes, which the whole text's ratio covers already.
    wide_bytes: bytes a code point above which the upper limits grow with them.
    bad_chunk_share: the document goes if a larger share of its judged chunks leaves chunk_band.
    """

    level: int = 3
    bands: tuple[Band, ...] = (
        Band(256, 1.30, 1.95),
        Band(512, 1.40, 2.05),
        Band(1024, 1.55, 2.20),
        Band(2048, 1.65, 2.30),
        Band(4096, 1.55, 2.40),
        Band(8192, 1.60, 2.52),
        Band(16384, 1.65, 2.62),
        Band(32768, 1.65, 2.75),
        Band(131072, 1.65, 3.00),
    )
    chunk_bytes: int = 4096
    min_chunk_bytes: int = 2048
    chunk_band: tuple[float, float] = (1.45, 2.50)
    bad_chunk_share: float = 0.40
    wide_bytes: float = 1.25


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("ratio", pa.float64()),
        ("n_chunks", pa.int64()),
        ("n_low_chunks", pa.int64()),
        ("n_high_chunks", pa.int64()),
        ("reason", pa.string()),
    ]
)


def line_repeats(raw: bytes) -> int:
    """Lines (split at \\n) that hold a word and equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x and x.strip()]
    return len(lines) - len(set(lines))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            covered[i : i + 3] = covered[j : j + 3] = b"\1\1\1"
    return sum(covered)


def judge(raw: bytes, rules: CompressionRules, packer: zstandard.ZstdCompressor) -> tuple:
    """(ratio, chunks judged, chunks below, chunks above, reason or None) of one text."""
    n = len(raw)
    if not n:
        return None, 0, 0, 0, None
    ratio = n / len(packer.compress(raw))
    width = n / max(1, len(raw.translate(None, CONTINUATION)))
    wide = width if width > rules.wide_bytes else 1.0
    low = high = judged = 0
    if n >= rules.chunk_bytes + rules.min_chunk_bytes:
        view = memoryview(raw)
        for at in range(0, n, rules.chunk_bytes):
            chunk = view[at : at + rules.chunk_bytes]
            if len(chunk) < rules.min_chunk_bytes:
                break
            judged += 1
            r = len(chunk) / len(packer.compress(chunk))
            low += r < rules.chunk_band[0]
            high += r > wide * rules.chunk_band[1]
    reason = None
    band = next((b for b in reversed(rules.bands) if n >= b.min_bytes), None)
    if band and ratio > wide * band.highest:
        reason = "repetitive"
    elif band and ratio < band.lowest:
        reason = "incompressible"
    elif high > rules.bad_chunk_share * judged:
        reason = "repetitive_chunks"
    elif low > rules.bad_chunk_share * judged:
        reason = "incompressible_chunks"
    return ratio, judged, low, high, reason


def _measure(rules: CompressionRules, size: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=rules.level, write_checksum=False)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows = []
                for raw in part.column(1).to_pylist():
                    words = raw.split()
                    rows.append(
                        (
                            len(words),
                            len(raw.translate(None, NOT_IN_WORDS)),
                            len(raw) - len(raw.translate(None, SYMBOLS)),
                            line_repeats(raw),
                            repeat_words(words),
                            *judge(raw, rules, packer),
                        )
                    )
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(RESULT)[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=RESULT)

    return run


def compression_bands(
    docs: DataFrame, rules: CompressionRules = CompressionRules(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of docs: counts, ratios, base verdict, the reason of the method and kept.

    A null text counts as empty; a text without words has base_failed true (n_words < 50).  Texts below the first
    band's length get no ratio verdict.  Repeated rows and null ids give a row each; other columns are not touched.  An
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    columns = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, reason string"
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), binary_text(text_col).alias("raw")).mapInArrow(
        _measure(rules), columns
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("reason").isNull())
