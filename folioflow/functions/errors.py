"""Expressions over the catalogues of errors, stages and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ERRORS, PROGRESS, WARNINGS


def error_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ERRORS), "code string, http_status int, message string")


def progress(stage: Column) -> Column:
    return F.coalesce(*[F.when(stage == k, v) for k, v in PROGRESS.items()])


def is_done(stage: Column) -> Column:
    return stage.isin("complete", "failed")


def status_payload(job: Column, stage: Column, code: Column) -> Column:
    """What a job's status object says, as JSON; fields without a value are left out."""
    fields = {"job_id": job.cast("string"), "stage": stage, "progress": progress(stage), "done": is_done(stage), "ok": stage != "failed", "code": F.when(stage == "failed", code)}
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def traced(step: Column, detail: Column, known: tuple[str, ...], most: int = 80) -> Column:
    """struct<step, detail> of a client's trace: unknown steps are not repeated, details are cut."""
    return F.struct(F.when(step.isin(*known), step).otherwise("unknown").alias("step"), F.substring(detail, 1, most).alias("detail"))


def warning(kind: str, number: Column) -> Column:
    before, _, after = WARNINGS[kind].partition("{n}")
    return F.concat(F.lit(before), number.cast("string"), F.lit(after)) if "{n}" in WARNINGS[kind] else F.lit(before)
