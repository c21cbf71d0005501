"""Files with a commit: what killed, failed and copied tasks stage never shows."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from folioflow.sources import sink

ROOT = Path(__file__).resolve().parents[1]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["key", "content"])


def files(root: Path) -> dict[str, bytes]:
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and p.relative_to(root).parts[0] != "_sent"}


@pytest.fixture()
def writer(tmp_path, monkeypatch):
    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(sink, "TaskContext", Context)
    return sink.Writer(str(tmp_path), "job", "key", "content")


def test_only_committed_attempts_are_published(spark, tmp_path, writer):
    rows = [("a/x", b"1" * 1000), ("b", b"")]
    copy = writer.write(iter([batch(rows)]))
    counted = writer.write(iter([batch(rows)]))
    assert copy.folder != counted.folder

    def killed():
        yield batch([("c", b"half")])
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    assert not [k for k in files(tmp_path) if not k.startswith("_staged")]  # nothing has its name before the commit
    writer.commit([counted, None])
    for _ in range(2):  # a publishing task that runs again
        sink.publish(spark, str(tmp_path), "job", str(tmp_path / "_sent"))
        assert {k: v for k, v in files(tmp_path).items() if not k.startswith("_staged")} == {"a/x": b"1" * 1000, "b": b""}
        assert {(r["key"], r["n_bytes"], r["error_code"]) for r in spark.read.parquet(str(tmp_path / "_sent")).collect()} == {("a/x", 1000, None), ("b", 0, None)}


def test_an_abort_leaves_nothing(tmp_path, writer):
    writer.abort([writer.write(iter([batch([("a", b"1")])])), None])
    assert files(tmp_path) == {}


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([("fine", bytearray(b"1")), ("../out", bytearray(b"2"))], "key string, content binary").repartition(2)
    with pytest.raises(Exception, match="leaves the output folder"):
        sink.write(df, str(tmp_path / "root"))
    assert files(tmp_path) == {}


def test_the_ledger(spark, tmp_path):
    rows = [("k1", 7, bytearray(b"abc")), (None, 8, bytearray(b"no file")), ("k2", 9, None), ("same", 1, bytearray(b"x")), ("same", 2, bytearray(b"yy"))]
    df = spark.createDataFrame(rows, "key string, n int, content binary").repartition(3)
    ledger = sink.write(df, str(tmp_path), ledger=str(tmp_path / "_sent" / "l"))
    got = {(r["key"], r["n"]): (r["n_bytes"], r["error_code"]) for r in ledger.collect()}
    assert got == {("k1", 7): (3, None), (None, 8): (None, None), ("k2", 9): (None, sink.FAILED), ("same", 1): (1, None), ("same", 2): (2, None)}
    assert {k: v for k, v in files(tmp_path).items() if k != "same"} == {"k1": b"abc"} and files(tmp_path)["same"] in (b"x", b"yy")
    assert not (tmp_path / "_staged" / "l").exists()
    sink.write(df.limit(0), str(tmp_path), ledger=str(tmp_path / "_sent" / "l"))
    assert sink.write(df.limit(0), str(tmp_path)).count() == 0


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from folioflow.sources import sink
root, marks = sys.argv[1], sys.argv[2]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").getOrCreate()

def rows(parts):
    for k, part in enumerate(parts):
        if k == 2 and not os.path.exists(f"{marks}/{part['id'].iloc[0] // 50}"):
            open(f"{marks}/{part['id'].iloc[0] // 50}", "w").close()
            os._exit(1)  # the worker dies amid its task, after files were staged
        part["key"] = "f/" + part["id"].astype(str)
        part["content"] = [str(i).encode() * 1000 for i in part["id"]]
        yield part[["key", "content"]]

df = spark.range(0, 100, 1, 2).mapInPandas(rows, "key string, content binary")
ledger = sink.write(df, root)
assert ledger.where("error_code IS NULL").count() == 100
"""


def test_workers_that_die(tmp_path):
    (tmp_path / "marks").mkdir()
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path / "out"), str(tmp_path / "marks")], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(list((tmp_path / "marks").iterdir())) == 2
    assert files(tmp_path / "out") == {f"f/{i}": str(i).encode() * 1000 for i in range(100)}
