"""What every operator with Python workers needs: the package itself on the executors."""

from __future__ import annotations

import logging
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: What is held at once where the session says nothing else.  To a worker: rows, and bytes where Spark can count them.
#: By the executor's JVM: rows of a Parquet file that is read, and bytes of one that is written before a row group ends.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 256,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
    "spark.sql.parquet.columnarReaderBatchSize": 128,
    "parquet.block.size": 8 << 20,
}


def _small_batches(spark: SparkSession) -> None:
    """Texts differ in length by orders of magnitude: Spark's batches of 10,000 rows can outgrow a worker, and those of
    4,096 rows that it reads make arrays of megabytes, over which the executor's heap grows and stays large.

    Only settings that the session, or its Hadoop configuration, has not made itself are changed.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for key, most in BATCH.items():
        if spark.conf.get(key, None) is None and hadoop.get(key) is None:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once for each Spark context, and bounds the batches of workers."""
    _small_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_siftwood_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siftwood-")) / "siftwood_sources.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(archive))
    context._siftwood_shipped = True


def setup_logging(spark: SparkSession, debug: bool = False, path: str | None = None) -> logging.Logger:
    """The driver's log to the console, or to a file of the driver, and Spark's at the same level."""
    log = logging.getLogger("siftwood")
    log.setLevel(logging.DEBUG if debug else logging.WARNING)
    for old in list(log.handlers):
        log.removeHandler(old)
    handler = logging.FileHandler(path) if path else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    spark.sparkContext.setLogLevel("INFO" if debug else "WARN")
    return log


_own_folder: str | None = None


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder of this process; on a cluster there is no folder that
    all machines would share, and the job ends here.
    """
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_folder = base = _own_folder or tempfile.mkdtemp(prefix="siftwood-")
    return f"{base.rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
