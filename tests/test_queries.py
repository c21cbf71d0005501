"""Every query of the registry against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return None if value is None else str(value)


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, sql, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = sql.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert got == want
    assert got


def test_entry(spark):
    assert entry.entry(spark).columns == ["conv_id", "markdown"]


def test_names_agree():
    assert set(ORACLES) <= set(entry.queries())
