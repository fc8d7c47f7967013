"""Token counts as delta-maintained rollups.

A batch of changes is a table of signed rows: an insert counts +1 times a document's size, a delete -1 times, and a
revision is both, with the old and the new size.  A commit sums a batch to one row for each (source, language,
tokenizer version) and stores that beside the others, under the batch's id.  Totals are sums over the stored batches,
so commits add up in any order.  A batch id that has been stored is not stored again, so a driver may repeat a commit
after a failure: each commit writes its sums to a staging folder of its own and renames it to the batch's name in one
step that fails where that name exists, so of two drivers with one batch id one alone commits.  `compact` folds stored
batches into one, which keeps the list of their ids.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.runtime import ship

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"

#: Versions by name: the vocabulary file of a public tokenizer.
TOKENIZERS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}

_encodings: dict[str, object] = {}


def _encoding(path: str):
    """One for each vocabulary and Python worker."""
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encodings[path]


def _counted(paths: list[str]):
    def run(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
        coders = [_encoding(p).encode_ordinary for p in paths]
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                counts = [[len(code(t)) if t else 0 for code in coders] for t in part.column("text").to_pylist()]
                keep = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in keep), pa.array(counts, pa.list_(pa.int64()))], names=[*keep, "counts"]
                )

    return run


def count_tokens(docs: DataFrame, columns: list[str], versions: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """columns of each row, with tokenizer, n_tokens and n_chars: one row for each version.  A null text has none.  An
    empty table gives an empty result.

    versions: a path of a vocabulary of ranks by name; the public vocabularies where it is not given.
    """
    ship(docs.sparkSession)
    if versions is None:
        import public_tokenizers

        versions = {name: public_tokenizers.path(file) for name, file in TOKENIZERS.items()}
    text = F.col(text_col).cast("string")
    inner = [f"__{i}" for i in range(len(columns))]
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(columns, inner)], F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), text.alias("text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    counted = rows.mapInArrow(_counted(list(versions.values())), ", ".join([*kinds, "counts array<bigint>"]))
    names = F.array(*[F.lit(v) for v in versions])
    each = counted.select(*inner, "n_chars", F.explode(F.arrays_zip(names.alias("tokenizer"), F.col("counts").alias("n_tokens"))).alias("c"))
    return each.select(*[F.col(i).alias(c) for i, c in zip(inner, columns)], "c.tokenizer", "c.n_tokens", "n_chars")


def signed(counted: DataFrame, sign: int) -> DataFrame:
    """Counted documents as changes: sign 1 for inserts and the new state of revisions, -1 for deletes and the old."""
    return counted.select(
        *KEYS, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"), (sign * F.col("n_chars")).alias("n_chars")
    )


class TokenRollup:
    """Totals below a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @staticmethod
    def _key(batch_id: str) -> str:
        return "batch-" + hashlib.sha256(batch_id.encode()).hexdigest()[:32]

    def _names(self) -> list[str]:
        folder = self._at("batches")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _folded(self, names: list[str]) -> set[str]:
        """What the folds among names stand for: those batches (and older folds) count no more, present or not."""
        folds = [f"{self.path}/ledgers/{n}" for n in names if n.startswith("folded-")]
        return {r["name"] for r in self.spark.read.schema("name string").json(folds).collect()} if folds else set()

    def committed(self, batch_id: str) -> bool:
        names = self._names()
        return self._key(batch_id) in names or self._key(batch_id) in self._folded(names)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Stores a batch of changes (KEYS and SUMS, signed); False, and no work, if that id is stored already.

        Null sources, languages or versions are a key of their own; an empty batch is stored as such.
        """
        if self.committed(batch_id):
            return False
        key = self._key(batch_id)
        staged = f"staged/{key}-{uuid.uuid4().hex}"
        sums = changes.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
        sums.where(" or ".join(f"{c} <> 0" for c in SUMS)).write.parquet(f"{self.path}/{staged}")
        if self._placed(staged, f"batches/{key}"):
            return True
        self._fs.delete(self._at(staged), True)  # another driver was faster with the same batch
        return False

    def _placed(self, staged: str, name: str) -> bool:
        """Renames a folder into place; False where the place is taken."""
        from py4j.protocol import Py4JJavaError

        fs = self._jvm.org.apache.hadoop.fs
        self._fs.mkdirs(self._at(name).getParent())
        files = fs.FileContext.getFileContext(self._at("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            files.rename(self._at(staged), self._at(name), options)
        except Py4JJavaError as error:
            if self._fs.exists(self._at(name)) and self._fs.exists(self._at(staged)):
                return False
            raise error
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_chars) over all stored batches; keys with all sums 0 go."""
        names = self._names()
        live = [n for n in names if n not in self._folded(names)]
        paths = [f"{self.path}/batches/{n}" for n in live]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
        return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Folds the stored batches into one.  The fold takes their place in the one step that renames it into place,
        after the list of what it stands for is written; a failure before or after leaves the totals as they are."""
        names = self._names()
        gone = self._folded(names)
        live = [n for n in names if n not in gone]
        if len(live) > 1:
            fold = "folded-" + hashlib.sha256("".join(live).encode()).hexdigest()[:32]
            ledger = sorted(gone | set(live))
            staged = f"staged/{fold}-{uuid.uuid4().hex}"
            self.totals().write.parquet(f"{self.path}/{staged}")
            self.spark.createDataFrame([(n,) for n in ledger], "name string").write.mode("overwrite").json(f"{self.path}/ledgers/{fold}")
            if not self._placed(staged, f"batches/{fold}"):
                self._fs.delete(self._at(staged), True)  # another driver has made the same fold
            gone |= set(live)
        for name in gone & set(names):
            self._fs.delete(self._at(f"batches/{name}"), True)
