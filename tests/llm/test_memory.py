"""What the executor's JVM and the workers hold at once is bounded, and the session's own settings stay."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftwood import runtime


@pytest.fixture
def unset(spark):
    """The session as it is before any operator has run."""
    before = {key: spark.conf.get(key, None) for key in runtime.BATCH}
    for key in runtime.BATCH:
        spark.conf.unset(key)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_batches_and_row_groups_are_small(unset, tmp_path):
    runtime.ship(unset)
    texts = unset.range(24_000, numPartitions=1).select("id", F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 256) for i in range(16)]).alias("text"))
    texts.write.parquet(str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("*.parquet")
    held = pq.ParquetFile(file).metadata
    assert held.num_rows == 24_000 and held.num_row_groups >= 2

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    got = [r.n for r in unset.read.parquet(str(tmp_path / "t")).mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 24_000 and max(got) <= 256
    assert unset.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "128"


def test_own_settings_stay(unset):
    hadoop = unset.sparkContext._jsc.hadoopConfiguration()
    unset.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
    hadoop.set("parquet.block.size", str(64 << 20))
    try:
        runtime.ship(unset)
        assert unset.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"
        assert unset.conf.get("parquet.block.size", None) is None
    finally:
        hadoop.unset("parquet.block.size")
