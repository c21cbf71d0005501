"""Streams of job events: status, rate limits, repeated jobs."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import latest_status

log = logging.getLogger(__name__)


def events(spark: SparkSession, path: str, like: DataFrame, ts: str = "ts", files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet events with ``ts`` as a timestamp, which watermarks need."""
    rows = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def status(stages: DataFrame) -> DataFrame:
    """The latest status of each job (complete or update mode). State is one row per job: its first terminal event and its latest event."""
    return latest_status(stages)


def requests_per_window(requests: DataFrame, key: str, ts: str, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """key, window_start, requests, admitted, rejected. State is one count per key and open window; windows close once the watermark has passed them."""
    counted = requests.withWatermark(ts, late).groupBy(key, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(key, F.col("w.start").alias("window_start"), "requests", F.least("requests", F.lit(limit).cast("long")).alias("admitted"), F.greatest(F.col("requests") - limit, F.lit(0).cast("long")).alias("rejected"))


def once_per_job(jobs: DataFrame, job: str, ts: str, within: str = "1 day") -> DataFrame:
    """Jobs without repeats that arrive within a time of the first."""
    return jobs.withWatermark(ts, within).dropDuplicatesWithinWatermark([job])


def run_to_end(stream: DataFrame, root: str, mode: str = "complete", each: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result, written under root; each batch is written whole before it counts.

    With the checkpoint of a run before, the stream goes on from there, and only what is new is returned.
    """
    last: list[int] = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{epoch}")
        if each is not None:
            each(batch, epoch)
        last.append(epoch)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{root}/checkpoint-{uuid.uuid4().hex}").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if not last:
        return spark.createDataFrame([], stream.schema)
    chosen = [last[-1]] if mode == "complete" else last
    return spark.read.schema(stream.schema).parquet(*[f"{root}/out/{e}" for e in chosen])


def publish(statuses: DataFrame, path: str) -> bool:
    """Append status events; best effort, so a failure to write them never fails a job, but is logged. What is wrong with the statuses themselves is an error."""
    statuses.schema  # noqa: B018  a plan that cannot be analysed is a fault of the caller
    try:
        statuses.write.mode("append").parquet(path)
        return True
    except (Py4JJavaError, PySparkException, OSError) as e:
        log.warning("statuses could not be published: %s", type(e).__name__)
        return False
