"""A sink of files with a commit: tasks stage, the driver decides which attempts count, and only then do files get their names.

1. ``staged_files``, a data source that is written to: every attempt of a task writes its files into a folder of its own, and a
   ledger of them. Attempts that are killed, fail or lose to a copy of theirs leave folders that nobody commits.
2. The commit writes down the one attempt of each task that counts, in one rename. An abort deletes all that was staged.
3. ``publish``, a job over the committed attempts: files are renamed to their keys and ledgers written. Both can be done again,
   so a lost task is repeated without harm.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .paths import contained, opened

FAILED = "RESULT_UPLOAD_FAILED"
#: What a ledger has besides the columns that are written.
STAGED, SIZE, CODE = "staged", "n_bytes", "error_code"


def staging(root: str, job: str) -> str:
    return f"{root.rstrip('/')}/_staged/{job}"


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of a task's attempt."""

    folder: str


class StagedFiles(DataSource):
    """Options: path (the root), job (a name of its own for each write), key, content (columns; "key" and "content")."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options["job"], self.options.get("key", "key"), self.options.get("content", "content"))


class Writer(DataSourceArrowWriter):
    def __init__(self, root: str, job: str, key: str, content: str):
        self.root, self.job, self.key, self.content = root, job, key, content

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        """Stage one task's rows: content as numbered files, the other columns as a ledger. Rows without a key are in the ledger only."""
        store, base = opened(staging(self.root, self.job))
        folder = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        store.create_dir(f"{base}/{folder}", recursive=True)
        ledger, n = None, 0
        for batch in iterator:
            rest = [c for c in batch.schema.names if c != self.content]
            found: list[tuple] = []
            for key, content in zip(batch.column(self.key), batch.column(self.content), strict=True):
                if not key.is_valid:
                    found.append((None, None, None))
                    continue
                contained(key.as_py())  # one that leaves the root is a fault of the caller
                found.append((str(n), *staged(store, f"{base}/{folder}/{n}", content.as_buffer() if content.is_valid else None)))
                n += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)]
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], [*rest, STAGED, SIZE, CODE])
            if ledger is None:
                sink = store.open_output_stream(f"{base}/{folder}/ledger")
                ledger = pq.ParquetWriter(sink, made.schema)
            ledger.write_batch(made)
        if ledger is not None:
            ledger.close()
            sink.close()
        return Attempt(folder)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, base = opened(staging(self.root, self.job))
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/committed.part") as f:
            f.write(json.dumps([m.folder for m in messages if m is not None]).encode())
        store.move(f"{base}/committed.part", f"{base}/committed")

    def abort(self, messages: list[Attempt | None]) -> None:
        drop(staging(self.root, self.job))


def staged(store, path: str, body: pa.Buffer | None) -> tuple[int | None, str | None]:
    """The size of a content and what went wrong with its file, which must be as long."""
    if body is None:
        return None, FAILED
    try:
        with store.open_output_stream(path) as f:
            f.write(body)
        return body.size, None if store.get_file_info(path).size == body.size else FAILED
    except OSError:
        return body.size, FAILED


def drop(folder: str) -> None:
    store, path = opened(folder)
    try:
        store.delete_dir(path)
    except (FileNotFoundError, OSError):  # there is none
        return


def publish(spark: SparkSession, root: str, job: str, ledger: str, key: str = "key") -> None:
    """Give the files of a committed job their names, and write its ledgers into the folder ``ledger``.

    A file that cannot get its name has RESULT_UPLOAD_FAILED in the ledger.
    """
    store, base = opened(staging(root, job))
    with store.open_input_stream(f"{base}/committed") as f:
        attempts = json.loads(f.read())  # one for each task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(staging(root, job))
        _, top = opened(root.rstrip("/"))
        to, out = opened(ledger.rstrip("/"))
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                if store.get_file_info(f"{base}/{folder}/ledger").type.name == "NotFound":
                    continue  # a task without rows
                to.create_dir(out, recursive=True)
                part = f"{out}/_{folder}-{uuid.uuid4().hex}"
                with store.open_input_file(f"{base}/{folder}/ledger") as f, to.open_output_stream(part) as g:
                    source, target = pq.ParquetFile(f), None
                    for rows in source.iter_batches():
                        codes = [c if s is None or c else named(store, f"{base}/{folder}/{s}", f"{top}/{contained(k)}", n) for k, s, n, c in zip(*(rows.column(c).to_pylist() for c in (key, STAGED, SIZE, CODE)), strict=True)]
                        rest = [c for c in rows.schema.names if c not in (STAGED, CODE)]
                        made = pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), pa.array(codes, pa.string())], [*rest, CODE])
                        target = target or pq.ParquetWriter(g, made.schema)
                        target.write_batch(made)
                    target.close()
                to.move(part, f"{out}/part-{folder.split('-')[0]}.parquet")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    if attempts:
        spark.createDataFrame([(a,) for a in attempts], "folder string").repartition(len(attempts), "folder").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def named(store, path: str, target: str, size: int) -> str | None:
    """Rename a staged file; done already, by an earlier try or a copy of this task, where the target is as long."""
    try:
        store.create_dir(posixpath.dirname(target), recursive=True)
        store.move(path, target)
    except OSError:
        there = store.get_file_info([path, target])
        return None if there[0].type.name == "NotFound" and there[1].size == size else FAILED
    return None


def write(rows: DataFrame, root: str, key: str = "key", content: str = "content", ledger: str | None = None, job: str | None = None) -> DataFrame:
    """Write each row's content under root/key, now, and return the ledger: the other columns, n_bytes, and error_code RESULT_UPLOAD_FAILED for what has no whole file.

    Rows without a key have no file. A content that is null or a file that cannot be written is an error of its row; a
    key that leaves the root fails the job, and nothing is written. Of rows with one key any one's file stays, whole. The ledger is stored in
    ``ledger`` (a folder under root unless given), whose rows it replaces, and reading it again writes nothing.
    """
    spark = rows.sparkSession
    job = job or uuid.uuid4().hex
    ledger = ledger or f"{root.rstrip('/')}/_sent/{job}"
    spark.dataSource.register(StagedFiles)
    drop(staging(root, job))  # what an earlier try of this job left
    rows = rows.drop(*[c for c in rows.columns if c in (STAGED, SIZE, CODE)])
    rows.write.format("staged_files").option("job", job).option("key", key).option("content", content).mode("append").save(root)
    drop(ledger)
    publish(spark, root, job, ledger, key)
    drop(staging(root, job))
    schema = StructType([f for f in rows.schema.fields if f.name != content]).add(SIZE, "long").add(CODE, "string")
    store, path = opened(ledger)
    if store.get_file_info(path).type.name == "NotFound":
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger)
