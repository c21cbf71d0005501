"""What a client that waits for its job is told, as a stream: changes of stage, lost contact, and a time-out for jobs that fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.errors import PROGRESS

#: Seconds that a client waits, failed polls in a row that it bears, and seconds after its end that a job is remembered.
DEADLINE, MOST_FAILURES, REMEMBERED = 720, 8, 7 * 86_400
ENDS = ("complete", "failed")
SECOND = 1_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Waiting(StatefulProcessor):
    """A job's polls in the order of their times, whatever order they come in: a poll waits in state until the watermark has passed it, its timer hands it on.

    State: the polls that wait, and one row for the job. Once a job has ended, what comes
    later is passed over (a late status never reopens it) until the job is forgotten.
    """

    def __init__(self, deadline: int, most: int, remembered: int):
        self.deadline, self.most, self.remembered = deadline * SECOND, most, remembered * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.polls = handle.getListState("polls", "us long, stage string, ok boolean")
        self.job = handle.getValueState("job", "began long, stage string, failures long, ended long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.job.exists() and self.job.get()[3] is not None:
            return
        for part in rows:
            found = [(int(us), stage, None if ok is None or ok != ok else bool(ok)) for us, stage, ok in zip(part["us"], part["stage"], part["ok"], strict=True)]
            self.polls.appendList(found)
            self.handle.registerTimer(min(-(-us // 1000) for us, _, _ in found))  # the next one is registered when this one fires
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        began, stage, failures, ended = self.job.get() if self.job.exists() else (None, None, 0, None)
        if ended is not None:
            if now >= ended + self.remembered:
                self.job.clear()
                self.polls.clear()
            return
        waiting = sorted(self.polls.get(), key=lambda p: (p[0], PROGRESS.get(p[1], -1), p[2] is not False)) if self.polls.exists() else []
        told: list[tuple[int, str | None, str | None]] = []
        used = 0
        for us, new, ok in waiting:
            if us > now or ended is not None:
                break
            used += 1
            if began is None:
                began = us
                self.handle.registerTimer(-(-(began + self.deadline + 1) // 1000))
            if us > began + self.deadline:
                break  # the client has left before
            if ok is not None:
                failures = 0 if ok else failures + 1
            if failures >= self.most:
                ended = us
                told.append((us, None, "SERVICE_UNAVAILABLE"))
            elif ok and new is not None and new != stage:
                stage = new
                told.append((us, stage, None))
                ended = us if stage in ENDS else None
        if ended is None and began is not None and now > began + self.deadline:
            ended = began + self.deadline
            told.append((ended, None, "CONVERSION_TIMEOUT"))
        if ended is not None:
            self.polls.clear()
            self.handle.registerTimer(-(-(ended + self.remembered) // 1000))
        elif used:
            rest = [(p[0], p[1], p[2]) for p in waiting[used:]]
            self.polls.put(rest) if rest else self.polls.clear()
            if rest:
                self.handle.registerTimer(-(-rest[0][0] // 1000))
        if began is not None:
            self.job.update((began, stage, failures, ended))
        if told:
            us, stages, codes = zip(*told, strict=True)
            yield pd.DataFrame({"job_id": [key[0]] * len(told), "us": us, "stage": pd.Series(stages, dtype=object), "error_code": pd.Series(codes, dtype=object)})

    def close(self) -> None:
        pass


def waiting(polls: DataFrame, late: str = "1 hour", deadline: int = DEADLINE, most: int = MOST_FAILURES, remembered: int = REMEMBERED) -> DataFrame:
    """job_id, ts, stage, error_code: a row for each change of a job's stage, and one for the error that ends the waiting.

    polls (a stream): job_id string, ts timestamp, stage (null: no status was there yet), ok (null likewise, false: the
    poll failed). So many failures in a row give SERVICE_UNAVAILABLE at the last of them, more seconds than the deadline
    after the first poll CONVERSION_TIMEOUT, also where nothing comes any more: timers of the watermark tell. Null jobs are passed over.
    Needs the RocksDB state store (with_rocks); append mode.
    """
    keyed = polls.withWatermark("ts", late).where(F.col("job_id").isNotNull())
    keyed = keyed.select("job_id", "ts", F.unix_micros("ts").alias("us"), F.col("stage").cast("string").alias("stage"), F.col("ok").cast("boolean").alias("ok"))
    told = keyed.groupBy("job_id").transformWithStateInPandas(Waiting(deadline, most, remembered), "job_id string, us long, stage string, error_code string", "Append", "EventTime")
    return told.select("job_id", F.timestamp_micros("us").alias("ts"), "stage", "error_code")


class with_rocks:
    """The state store that timers need, for streams started within."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.NAME, None)
        self.conf.set(self.NAME, ROCKS)

    def __exit__(self, *error) -> None:
        self.conf.unset(self.NAME) if self.before is None else self.conf.set(self.NAME, self.before)
