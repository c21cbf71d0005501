"""Files of documents as relations, and the sinks of what they become."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sink
from .paths import opened

#: The schema of the binary file source, which streams need beforehand.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length: a scan that opens no file. Spark's scans pass over empty files; a table of jobs joined to this finds them missing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")


def documents(spark: SparkSession, folder: str, max_bytes: int) -> DataFrame:
    """path, length, content of the files that are not too large. The length filter reaches the scan, so larger files are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where((F.col("length") <= max_bytes) & (F.col("length") > 0)).select("path", "length", "content")


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)


def uploaded(rows: DataFrame, root: str, key: str = "key", content: str = "content") -> DataFrame:
    """key, n_bytes, error_code: each row's content written under root/key, through the file system that root names.

    The rows are written when this is called, by a commit (see sink), and what is returned is
    the stored ledger: reading it again writes nothing.
    """
    return sink.write(rows.select(F.col(key).alias("key"), F.col(content).alias("content")), root)


def write_files(rows: DataFrame, root: str, key: str = "key", content: str = "content") -> int:
    """Write each row's content under root/key; how many there are. Only counts come to the driver; a file that cannot be written is an error."""
    sent = uploaded(rows, root, key, content)
    n, failed = sent.agg(F.count(F.lit(1)), F.count("error_code")).first()
    if failed:
        raise OSError(f"RESULT_UPLOAD_FAILED: {failed} of {n} files")
    return n


def delete_files(rows: DataFrame, path: str = "path") -> int:
    """Delete the files that rows name, best effort: what is gone already or cannot be deleted is passed over; how many went."""

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for p in batch.column(path).to_pylist():
                try:
                    store, name = opened(p)
                    store.delete_file(name)
                    n += 1
                except (OSError, ValueError):  # gone, not to be deleted, or no path
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.select(path).mapInArrow(gone, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
