"""Queries whose SQL casts numbers with a fraction to whole ones: a cast rounds, halves to the even neighbour."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import duckdb
import pytest

import __spark_entry__ as entry


def both(spark, folder, name: str) -> tuple[list, list]:
    """The rows of a query and of its SQL over the tables of a folder, as text."""
    df = entry.queries()[name](spark, str(folder))
    got = sorted(str([str(v) for v in r]) for r in df.collect())
    sql = duckdb.connect()
    for path in folder.glob("*.parquet"):
        sql.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sql.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return got, sorted(str([str(v) for v in r]) for r in want)


def test_prices_with_a_half(spark, tmp_path):
    prices = [20000.5, 20001.5, 60000.5, 60001.5, 20000.49, 60000.51]
    rows = [(key, 1, price) for key, price in ((k * 252 + r, p) for k, p in enumerate(prices) for r in range(60))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 5.0)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got, want = both(spark, tmp_path, "prepare_job")
    assert got == want and any("INVALID_FILE_FORMAT" in r for r in got) and any("FILE_TOO_LARGE" in r for r in got)


@pytest.mark.parametrize("ms", [400, 500, 600])
def test_polls_within_a_second_of_a_week(spark, tmp_path, ms):
    end = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=604_800 * 2820)
    at = [end - timedelta(hours=2), end - timedelta(milliseconds=1000 - ms), end + timedelta(hours=1)]
    rows = [(i, t.replace(tzinfo=None), 7, "signup", v) for i, (t, v) in enumerate(zip(at, (5.0, 50.0, 10.0), strict=True))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got, want = both(spark, tmp_path, "stream_waiting")
    assert got == want and len(got) == 5
