"""Files, mailboxes and folders as tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.config import Flags
from siftwood.functions import archives, content, exif, formats, mail
from siftwood.runtime import ship


def read_files(spark: SparkSession, path: str, flags: Flags = Flags(), glob: str | None = None) -> DataFrame:
    """(path, content, declared_mime, length, modified): all files at a path and below, none above the size limit.

    The type is declared by the name; the limit reaches the scan, so larger files are not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).where(F.col("length") <= flags.max_file_size)
    kinds = F.create_map(*[F.lit(x) for pair in content.EXTENSION_TYPES.items() for x in pair])
    return files.select("path", "content", kinds[content.extension(F.col("path"))].alias("declared_mime"), "length", F.col("modificationTime").alias("modified"))


def read_mail(spark: SparkSession, path: str, flags: Flags = Flags()) -> DataFrame:
    """(node_id, status, headers, parts) of the message files of a folder."""
    return mail.parsed_mail(read_files(spark, path, flags), "path")


def read_exif(spark: SparkSession, path: str, flags: Flags = Flags(), glob: str = "*.{jpg,jpeg,png,tif,tiff,gif,webp,JPG,JPEG,PNG,TIF,TIFF}") -> DataFrame:
    """(path, format, width, height, mode, exif, gps) of the images of a folder and all below; the last two are maps of
    texts.  Files that are no image have nulls."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [exif.picture(raw or b"") for raw in batch.column("content").to_pylist()]
            each = lambda f, kind: pa.array([f(x) if x else None for x in found], kind)
            texts = pa.map_(pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), each(lambda x: x.format, pa.string()), each(lambda x: x.width, pa.int32()), each(lambda x: x.height, pa.int32()), each(lambda x: x.mode, pa.string()),
                 each(lambda x: [(k, str(v)) for k, v in x.fields.items()], texts), each(lambda x: [(k, str(v)) for k, v in x.gps.items()], texts)],
                names=["path", "format", "width", "height", "mode", "exif", "gps"],
            )

    files = read_files(spark, path, flags, glob).select("path", "content")
    return files.mapInArrow(run, "path string, format string, width int, height int, mode string, exif map<string,string>, gps map<string,string>")


def archive_hashes(spark: SparkSession, path: str, algorithm: str = "sha256", flags: Flags = Flags()) -> DataFrame:
    """(path, member, size, digest) of every file in the zip, 7z and RAR archives of a folder; a member that cannot be
    unpacked has a null digest."""
    import hashlib

    hashlib.new(algorithm)  # an unknown one fails here and not on the workers
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(name, m, size, hashlib.new(algorithm, body).hexdigest() if body is not None else None) for m, size, body in archive_members(raw or b"", flags)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["path", "member", "size", "digest"])

    return read_files(spark, path, flags).select("path", "content").mapInArrow(run, "path string, member string, size long, digest string")


def archive_members(raw: bytes, flags: Flags) -> Iterator[tuple[str, int, bytes | None]]:
    """(name, size, bytes or None) of an archive's files; nothing for other files and for bombs."""
    if raw[:2] == b"PK":
        file = formats.File(raw, None, "application/zip", flags.max_compression_ratio, flags.max_file_size)
        for child in formats.zip_archive(file).children:
            yield child["filename"], len(child["content"]), child["content"]
        return
    try:
        members = archives.seven_zip_members(raw, flags.max_compression_ratio, flags.max_file_size) if raw[:6] == archives.SEVEN_ZIP else archives.rar_members(raw)
    except (ValueError, OverflowError, PermissionError, struct.error):
        return
    for m in members:
        if not m.folder:
            yield m.name, m.size, m.content


def watch_files(spark: SparkSession, path: str, flags: Flags = Flags()) -> DataFrame:
    """A stream of files as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).where(F.col("length") <= flags.max_file_size)
