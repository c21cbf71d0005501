"""Jobs over time: status, changes, rate limits, retention. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.errors import is_done, progress
from .ordered import folded


def before_settled(events: DataFrame, job: str = "job_id", ts: str = "ts", stage: str = "stage") -> DataFrame:
    """Events up to the first that ends the job; later ones are ignored."""
    end = F.min(F.when(is_done(F.col(stage)), F.col(ts))).over(Window.partitionBy(job))
    return events.withColumn("__end", end).where(F.col("__end").isNull() | (F.col(ts) <= F.col("__end"))).drop("__end")


def latest_status(events: DataFrame, job: str = "job_id", ts: str = "ts", stage: str = "stage") -> DataFrame:
    """job, stage, ts, progress, done, ok of each job. Of events at one time the one with the most progress counts.

    An aggregate alone: the terminal event is the minimum among terminal ones, otherwise
    the latest event is; no window buffers a job's events.
    """
    at = F.struct(F.col(ts).alias("ts"), progress(F.col(stage)).alias("progress"), F.col(stage).alias("stage"))
    last = events.groupBy(job).agg(F.min(F.when(is_done(F.col(stage)), at)).alias("end"), F.max(at).alias("latest"))
    now = last.select(job, F.coalesce("end", "latest").alias("s"))
    return now.select(job, F.col("s.stage").alias("stage"), F.col("s.ts").alias("ts"), F.col("s.progress").alias("progress"), is_done(F.col("s.stage")).alias("done"), (F.col("s.stage") != "failed").alias("ok"))


def status_changes(events: DataFrame, job: str = "job_id", ts: str = "ts", stage: str = "stage") -> DataFrame:
    """The events at which a job's stage differs from the one before. Of events at one time the one with less progress comes first."""
    before = F.lag(stage).over(Window.partitionBy(job).orderBy(F.col(ts), progress(F.col(stage)), F.col(stage)))
    return events.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(stage)))


def lost_contact(polls: DataFrame, most: int = 8, job: str = "job_id", at: str = "ts", ok: str = "ok") -> DataFrame:
    """job, ts, error_code of jobs of which so many polls in a row failed, with the time of the poll that reached the number.

    ok is null for a poll that found no status yet: it neither fails nor ends a row of failures.
    """

    def step(failures: list[int], fine: bool | None) -> tuple[int]:
        if fine is not None:
            failures[0] = 0 if fine else failures[0] + 1
        return (failures[0],)

    counted = folded(polls, job, [at], [ok], {"failures": "long"}, lambda: [0], step).where(F.col("failures") >= most)
    return counted.groupBy(job).agg(F.min(at).alias(at)).withColumn("error_code", F.lit("SERVICE_UNAVAILABLE"))


def out_of_order(events: DataFrame, job: str = "job_id", ts: str = "ts", stage: str = "stage", tie: str = "event_id") -> DataFrame:
    """events with ``allowed``: whether the stage may follow the one before. Progress never falls, and nothing follows an end."""
    before = Window.partitionBy(job).orderBy(ts, tie)
    last = F.lag(stage).over(before)
    return events.withColumn("allowed", last.isNull() | (~is_done(last) & (progress(F.col(stage)) >= progress(last))))


def admitted(requests: DataFrame, key: str, ts: str, limit: int, seconds: int, tie: str) -> DataFrame:
    """requests with window_start, place (in its fixed window, by time, then tie) and admitted: whether the limit had room."""
    start = F.window(ts, f"{seconds} seconds")["start"]
    place = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, tie))
    return requests.withColumn("window_start", start).withColumn("place", place).withColumn("admitted", F.col("place") <= limit)


def expired(listing: DataFrame, now: Column, path: str = "path", uploaded: str = "uploaded_at") -> DataFrame:
    """The objects older than their class is kept, with class; objects of no class are kept for ever."""
    kind = paths.retention_class(F.col(path))
    age = F.unix_micros(now) - F.unix_micros(F.col(uploaded))
    return listing.withColumn("class", kind).where(age >= paths.retention_minutes(F.col("class")).cast("long") * 60_000_000)


def paged_deletions(listing: DataFrame, now: Column, page: int = 250, most: int = 500, path: str = "path", uploaded: str = "uploaded_at") -> DataFrame:
    """What one sweep deletes: expired objects in the order of path, up to the end of the page in which ``most`` is reached.

    Only bounded prefixes are ordered: the ``most``-th expired path, one count up to it,
    and at most a page of paths after it.
    """
    gone = expired(listing, now, path, uploaded)
    edge = [r[0] for r in gone.select(path).orderBy(path).limit(most).collect()]
    if len(edge) < most:
        return gone
    passed = listing.where(F.col(path) <= edge[-1]).count()
    rest = -passed % page
    after = [r[0] for r in listing.where(F.col(path) > edge[-1]).select(path).orderBy(path).limit(rest).collect()] if rest else []
    return gone.where(F.col(path) <= (after or edge)[-1])


def sweep_counts(deleted: DataFrame) -> DataFrame:
    return deleted.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def admission_replay(requests: DataFrame, capacity: int, order: str, amount: str = "amount", group: str = "pool") -> DataFrame:
    """requests (reservations positive, releases negative) with ``reserved``, the ledger after each, and ``fits``: whether it was admitted.

    A reservation that does not fit is refused and leaves the ledger as it is; a release
    never takes it under zero. Null amounts change nothing. The ledger of a pool is sequential.
    """

    def step(ledger: list[int], size: int | None) -> tuple[int, bool]:
        fits = ledger[0] + (size or 0) <= capacity or (size or 0) <= 0
        if fits:
            ledger[0] = max(0, ledger[0] + (size or 0))
        return ledger[0], fits

    return folded(requests, group, [order], [amount], {"reserved": "long", "fits": "boolean"}, lambda: [0], step)


def overdue(events: DataFrame, now: Column, seconds: int = 720, job: str = "job_id", ts: str = "ts", stage: str = "stage") -> DataFrame:
    """The jobs that have not ended and began more than ``seconds`` ago, with the error that a waiting client reports."""
    first = events.groupBy(job).agg(F.min(ts).alias("began"), F.max(is_done(F.col(stage))).alias("done"))
    return first.where(~F.col("done") & (F.unix_micros(now) - F.unix_micros(F.col("began").cast("timestamp")) > seconds * 1_000_000)).select(job, "began", F.lit("CONVERSION_TIMEOUT").alias("error_code"))


def settled(response: DataFrame, polled: DataFrame, job: str = "job_id") -> DataFrame:
    """job, ok, code from two sources of a job's end: the first success wins, a typed error is preferred to none."""
    both = response.select(job, F.col("ok").alias("ok_a"), F.col("code").alias("code_a")).join(polled.select(job, F.col("ok").alias("ok_b"), F.col("code").alias("code_b")), job, "full")
    ok = F.coalesce("ok_a", F.lit(False)) | F.coalesce("ok_b", F.lit(False))
    return both.select(job, ok.alias("ok"), F.when(~ok, F.coalesce("code_a", "code_b", F.lit("CONVERSION_FAILED"))).alias("code"))
