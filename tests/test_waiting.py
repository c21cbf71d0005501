from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from folioflow.streaming import jobs
from folioflow.streaming.waiting import ENDS, waiting, with_rocks

START = datetime(2024, 5, 1, tzinfo=timezone.utc)
SCHEMA = "job_id string, ts timestamp, stage string, ok boolean"


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def run(spark, tmp_path, lots: list[list[tuple]], **options) -> list[list[tuple]]:
    """What each lot of polls (job, second, stage, ok), given to the stream one after the other, makes it tell; it is started anew for each."""
    out = []
    for lot in lots:
        spark.createDataFrame([(j, at(s), stage, ok) for j, s, stage, ok in lot], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with with_rocks(spark):
            told = jobs.run_to_end(waiting(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), **options), str(tmp_path), "append", checkpoint=str(tmp_path / "state"))
        out.append(sorted((r["job_id"], (r["ts"].astimezone(timezone.utc) - START).total_seconds(), r["stage"], r["error_code"]) for r in told.collect()))
    return out


def told_by_hand(polls: list[tuple], deadline: int, most: int) -> list[tuple]:
    """A client that polls, for one job, told everything in order."""
    out, stage, failures = [], None, 0
    for job, s, new, ok in sorted(polls, key=lambda p: p[1]):
        if s > polls_begin(polls) + deadline:
            break
        if ok is None:
            continue
        failures = 0 if ok else failures + 1
        if failures == most:
            return [*out, (job, s, None, "SERVICE_UNAVAILABLE")]
        if ok and new is not None and new != stage:
            stage = new
            out.append((job, s, stage, None))
            if stage in ENDS:
                return out
    return [*out, (polls[0][0], polls_begin(polls) + deadline, None, "CONVERSION_TIMEOUT")]


def polls_begin(polls: list[tuple]) -> float:
    return min(p[1] for p in polls)


TICK = ("tick", 10**6, None, None)


def test_a_silent_job_times_out(spark, tmp_path):
    first = [("a", 0, "accepted", True), ("a", 5, "converting", True), ("b", 0, "accepted", True)]
    lots = [first, [("b", 700, "complete", True)], [("c", 5000, "accepted", True)], [TICK]]
    got = run(spark, tmp_path, lots, late="10 seconds")
    assert got[0] == []  # the watermark has passed none
    assert got[1] == [("a", 0.0, "accepted", None), ("a", 5.0, "converting", None), ("b", 0.0, "accepted", None)]
    assert got[2] == [("a", 720.0, None, "CONVERSION_TIMEOUT"), ("b", 700.0, "complete", None)]
    assert got[3] == [("c", 5000.0, "accepted", None), ("c", 5720.0, None, "CONVERSION_TIMEOUT")]


def test_order_failures_and_late_updates(spark, tmp_path):
    rows = [("x", 30, "uploading", True), ("x", 10, "accepted", True), ("x", 20, None, None), ("x", 40, "complete", True), ("x", 50, "converting", True)]
    failing = [("y", s, None, s == 3 or None if s in (3, 4) else False) for s in range(14)]
    slow = [("z", 0, "accepted", True), ("z", 721, "complete", True), (None, 3, "accepted", True)]
    got = run(spark, tmp_path, [rows[:1] + failing[:6], rows[1:] + failing[6:] + slow, [TICK]], late="1000 seconds")
    told = sorted(got[0] + got[1] + got[2])
    assert [t for t in told if t[0] == "x"] == [("x", 10.0, "accepted", None), ("x", 30.0, "uploading", None), ("x", 40.0, "complete", None)]
    assert [t for t in told if t[0] == "y"] == [("y", 12.0, None, "SERVICE_UNAVAILABLE")]  # 3 answered, 4 found none: 5 to 12 failed
    assert [t for t in told if t[0] == "z"] == [("z", 0.0, "accepted", None), ("z", 720.0, None, "CONVERSION_TIMEOUT")]
    assert {t[0] for t in told} <= {"x", "y", "z"}


def test_many_jobs_in_lots_against_a_client_each(spark, tmp_path):
    rng = random.Random(2)
    jobs_ = {}
    for j in range(40):
        seconds = sorted(rng.sample(range(0, 1500), rng.randint(1, 25)))
        jobs_[f"j{j}"] = [(f"j{j}", s, *rng.choice([("accepted", True), ("converting", True), (None, None), (None, False), (None, False), (None, False), ("complete", True)] if rng.random() < 0.9 else [("failed", True)])) for s in seconds]
    rows = [p for polls in jobs_.values() for p in polls]
    rng.shuffle(rows)
    lots = [rows[i::3] for i in range(3)] + [[TICK]]
    got = run(spark, tmp_path, lots, late="2000 seconds", most=3)
    want = sorted((j, float(s), stage, code) for polls in jobs_.values() for j, s, stage, code in told_by_hand(polls, 720, 3))
    assert sorted((t for lot in got for t in lot), key=str) == sorted(want, key=str)


def test_nothing(spark, tmp_path):
    assert run(spark, tmp_path, [[]]) == [[]]


@pytest.fixture(autouse=True)
def restored(spark):
    yield
    assert "RocksDB" not in (spark.conf.get(with_rocks.NAME, "") or "")
