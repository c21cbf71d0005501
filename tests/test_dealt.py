"""Documents that queries make of rows: how they are dealt to tasks and handed on."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from folioflow.operators import media
from folioflow.plans import document_queries as queries

MADE = ["pdf_subset_fonts", "protected_documents", "pdf_directions", "office_word_tree", "items_by_sql", "pdf_merged_tables"]


@pytest.mark.parametrize("name", MADE)
def test_a_small_file_of_many_rows_is_many_tasks(spark, tmp_path, name):
    n = 20_000
    columns = {"c_custkey": range(n), "p_partkey": range(n), "p_name": ["x"] * n, "p_brand": ["b"] * n, "o_orderkey": range(n), "o_custkey": range(n), "o_orderstatus": ["F"] * n, "o_orderpriority": ["5"] * n}
    for t, letter in (("customer", "c"), ("part", "p"), ("orders", "o")):
        pq.write_table(pa.table({k: list(v) for k, v in columns.items() if k[0] == letter}), tmp_path / f"{t}.parquet")
    assert entry.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 4


def test_documents_are_handed_on_by_bytes():
    frames = list(queries.handed(((i, bytes(6 << 20)) for i in range(10)), ["key", "content"]))
    assert [len(f) for f in frames] == [3, 3, 3, 1] and [k for f in frames for k in f["key"]] == list(range(10))
    assert list(queries.handed(iter(()), ["key", "content"])) == []


def test_references_are_told_apart_in_one_join(spark):
    files = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    used = spark.createDataFrame([(2,), (2,), (None,), (5,)], "k long")
    told = media.by_reference(files, used, "k")
    assert sorted(told.collect(), key=str) == sorted([("unreferenced", 1), ("referenced", 2), ("referenced", 2), ("unreferenced", None)], key=str)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" in plan


def test_archives_are_on_the_disk_a_lot_at_a_time(spark, sf_dir, tmp_path, monkeypatch):
    lots, real = [], queries.write_files
    monkeypatch.setattr(queries, "LOT_BYTES", 4 << 20, raising=False)
    monkeypatch.setattr(queries, "shared_dir", lambda _: str(tmp_path / "run"))
    monkeypatch.setattr(queries, "write_files", lambda files, folder: lots.append(real(files, folder)))
    rows = entry.queries()["archive_directories"](spark, sf_dir).collect()
    assert sum(lots) == len(rows) + 5  # and texts, which are not judged
    assert len(lots) > 2 and max(lots) < len(rows) / 2
    assert not list((tmp_path / "run").rglob("*.docx"))
    assert len({r["name"] for r in rows}) == len(rows)
