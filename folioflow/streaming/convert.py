"""A landing folder to Markdown files, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Limits
from ..operators.convert import converted, tree
from ..operators.outcome import files_of
from ..sources.files import delete_files, stream
from ..sources.sink import write


def convert_stream(spark: SparkSession, landing: str, root: str, checkpoint: str, limits: Limits = Limits(), delete_sources: bool = False) -> StreamingQuery:  # noqa: B008
    """Convert the files that arrive in landing; outcomes go to root/outcomes, files to root/files.

    A batch is one pass: documents are converted, delivered and written, and the ledger of that write, without any
    contents, is the batch's outcomes. Only then are its sources deleted, so a batch that is run again finds them and
    overwrites what it had written.
    """

    def batch(docs: DataFrame, epoch: int) -> None:
        done = converted(docs.select("path", "length", "content"), limits)
        slim = F.struct("path", "stem", "source_type", "pages_or_slides", "media_count", "warnings", "shape", "content_type", F.col("error_code").alias("code"))
        files = files_of(done.select(slim.alias("doc"), "stem", "shape", tree().alias("files")), "doc", limits)
        code = F.coalesce("doc.code", "error_code")
        rows = files.select("doc.*", code.alias("failed"), F.when(code.isNull(), F.concat(F.md5("doc.path"), F.lit("/"), F.col("name"))).alias("key"), "content").drop("code")
        out = f"{root}/outcomes/batch={epoch}"
        sent = write(rows, f"{root}/files", ledger=out, job=f"batch-{epoch}")
        if delete_sources:
            delete_files(sent.where("failed IS NULL AND error_code IS NULL").select("path"))

    return stream(spark, landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """What a stream has written so far: a row for each document, error_code for those that have no file."""
    found = spark.read.parquet(f"{root}/outcomes")
    return found.withColumn("error_code", F.coalesce("failed", "error_code")).drop("failed")
