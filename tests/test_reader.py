from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioflow.sources import reader as r
from folioflow.sources import samples


@pytest.fixture()
def folder(tmp_path):
    files = {"a.docx": samples.docx(samples.para(samples.run("x"))), "b/c.PDF": b"%PDF-1", "b/empty.pptx": b"", "b/_temporary/x.pdf": b"no", ".hidden.pdf": b"no", "d.txt": b"text" * 100, "b/large.pdf": b"%PDF-" + bytes(5000)}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path, files


def test_files_and_what_is_asked_of_them(spark, folder):
    root, files = folder
    rows = {x["name"]: x for x in r.document_files(spark, str(root)).collect()}
    assert set(rows) == {"a.docx", "c.PDF", "empty.pptx", "d.txt", "large.pdf"}
    for path in ("a.docx", "b/c.PDF", "b/empty.pptx", "d.txt", "b/large.pdf"):
        row = rows[path.split("/")[-1]]
        assert bytes(row["content"]) == files[path] and row["length"] == len(files[path]) and row["path"] == str(root / path)
    assert rows["c.PDF"]["extension"] == ".pdf" and rows["d.txt"]["directory"] is None
    assert {m["name"] for m in rows["a.docx"]["directory"]["members"]} >= {"word/document.xml"}
    slim = r.document_files(spark, str(root), "length bigint, name string")
    assert slim.columns == ["length", "name"] and slim.count() == 5
    assert r.document_files(spark, str(root / "a.docx")).count() == 1
    with pytest.raises(Exception, match="no columns"):
        r.document_files(spark, str(root), "colour string").collect()


def test_filters_reach_the_planning(spark, folder):
    root, _ = folder
    df = r.document_files(spark, f"file://{root}").where((F.col("length") <= 1000) & (F.col("length") > 0) & F.col("extension").isin(".pdf", ".docx") & (F.col("name") != "zzz"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "length <= 1000" not in plan.split("BatchScan")[0] and "extension" not in plan.split("BatchScan")[0].replace("extension#", "")
    assert {x["name"] for x in df.collect()} == {"c.PDF"} | ({"a.docx"} if (root / "a.docx").stat().st_size <= 1000 else set())
    reader = r.Reader(str(root), ["name"], 100)
    other = r.StringStartsWith(("colour",), "x")
    assert list(reader.pushFilters([r.LessThan(("length",), 10), other, r.IsNotNull(("name",))])) == [other]
    assert [f.name for p in reader.partitions() for f in p.files] == ["c.PDF", "empty.pptx"]


def test_tasks_are_planned_by_bytes():
    rng = random.Random(1)
    files = sorted((r.File(f"p{i}", f"n{i}", ".pdf", rng.choice([0, 100, 5_000_000, 60 << 20, 100 << 20, 200 << 20]), 0) for i in range(500)), key=lambda f: -f.length)
    tasks = r.packed(files, lambda f: f.length + r.OPEN_BYTES, r.TASK_BYTES)
    assert sorted(f.path for t in tasks for f in t) == sorted(f.path for f in files)
    for t in tasks:
        total = sum(f.length + r.OPEN_BYTES for f in t)
        assert len(t) == 1 or total <= r.TASK_BYTES
        assert sum(f.length >= 90 << 20 for f in t) <= 1
    least = sum(f.length + r.OPEN_BYTES for f in files if f.length < r.TASK_BYTES) / r.TASK_BYTES + sum(f.length >= r.TASK_BYTES for f in files)
    assert len(tasks) < 1.5 * least


def test_no_files(spark, tmp_path):
    assert r.document_files(spark, str(tmp_path)).count() == 0


def test_directories_leave_together_by_their_entries(tmp_path, monkeypatch):
    for i in range(10):
        (tmp_path / f"{i}.docx").write_bytes(samples.stored({f"m{k}": b"x" for k in range(3)}))
    (tmp_path / "empty.docx").write_bytes(b"")

    def batches(*columns):
        reader = r.Reader(str(tmp_path), list(columns), r.TASK_BYTES)
        return [b for p in reader.partitions() for b in reader.read(p)]

    one = batches("name", "directory")
    assert len(one) == 1 and one[0].num_rows == 11 and sum(len(d["members"]) for d in one[0].column("directory").to_pylist() if d) == 30
    monkeypatch.setattr(r, "TOGETHER_ENTRIES", 6)
    assert sorted(b.num_rows for b in batches("name", "directory")) == [1, 2, 2, 2, 2, 2]
    assert [b.num_rows for b in batches("content", "directory")] == [1] * 11
