"""Files of a folder as a data source of their own: tasks are planned by bytes, filters on names and sizes decide what is planned at all, and contents are read only where they are asked for.

    spark.dataSource.register(DocumentFiles)
    spark.read.format("document_files").load(folder)

Unlike Spark's own scan of binary files this one tells empty files too, never puts two files near the limit into
one task, and can read an archive's directory (column ``directory``) without the archive.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from .paths import opened
from .zipdir import DIRECTORY, directory

SCHEMA = f"path string, name string, extension string, length bigint, modified timestamp, content binary, directory {DIRECTORY}"
#: Bytes that one task reads, and files that it opens, at most; a file of more bytes is a task of its own.
TASK_BYTES, TASK_FILES = 128 << 20, 2_000
#: What opening a file costs, in bytes read.
OPEN_BYTES = 256 << 10
#: Files whose directories leave in one batch, at most, and the entries of them that end one: a batch costs more than reading a directory.
TOGETHER, TOGETHER_ENTRIES = 64, 10_000
ARROW = {
    "path": pa.string(),
    "name": pa.string(),
    "extension": pa.string(),
    "length": pa.int64(),
    "modified": pa.timestamp("us", "UTC"),
    "content": pa.binary(),
    "directory": pa.struct([("members", pa.list_(pa.struct([("name", pa.string()), ("file_size", pa.int64()), ("compress_size", pa.int64())]))), ("repeated", pa.int32()), ("overlapping", pa.int32()), ("bytes_read", pa.int64())]),
}


@dataclass(frozen=True)
class File:
    path: str
    name: str
    extension: str
    length: int
    modified: int


@dataclass
class Files(InputPartition):
    files: tuple[File, ...]


class DocumentFiles(DataSource):
    """Options: path (a folder, searched with all its folders, or a file), taskBytes. Columns: those of SCHEMA, or the ones that the reader's schema names."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        unknown = set(schema.names) - set(ARROW)
        if unknown:
            raise ValueError(f"document_files has no columns {sorted(unknown)}")
        return Reader(self.options["path"], schema.names, int(self.options.get("taskBytes", TASK_BYTES)))


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], task_bytes: int):
        self.path, self.columns, self.task_bytes = path, columns, task_bytes
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps what concerns names, extensions and lengths; Spark evaluates the rest."""
        kinds = {EqualTo: "=", In: "in", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", StringEndsWith: "ends", StringStartsWith: "starts"}
        for f in filters:
            attribute = getattr(f, "attribute", ())
            column = attribute[0] if len(attribute) == 1 else None
            if column in ("path", "name", "extension", "length") and isinstance(f, IsNotNull):
                continue  # they never are
            if column in ("path", "name", "extension", "length") and type(f) in kinds:
                self.tests.append((column, kinds[type(f)], f.value))
            else:
                yield f

    def passes(self, file: File) -> bool:
        return all(TESTS[kind](getattr(file, column), value) for column, kind, value in self.tests)

    def partitions(self) -> list[Files]:
        found = sorted((f for f in listed(self.path) if self.passes(f)), key=lambda f: (-f.length, f.path))
        reads = "content" in self.columns
        cost = lambda f: (f.length if reads else 0) + OPEN_BYTES
        return [Files(tuple(task)) for task in packed(found, cost, self.task_bytes)]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        """A batch for each file whose content is read, so that no batch holds two; directories leave together."""
        if partition is None:  # nothing was planned
            return
        store, _ = opened(self.path)
        step = 1 if "content" in self.columns else TOGETHER if "directory" in self.columns else 1000
        held: list[dict] = []
        entries = 0
        for f in partition.files:
            held.append({c: getattr(f, c, None) for c in self.columns} | self.opened(store, f))
            entries += len((held[-1].get("directory") or {}).get("members", ()))
            if len(held) == step or entries >= TOGETHER_ENTRIES:
                yield self.batch(held)
                held, entries = [], 0
        if held:
            yield self.batch(held)

    def opened(self, store, f: File) -> dict:
        """What the file has to be opened for, as far as it is asked for."""
        reads = {"content", "directory"} & set(self.columns)
        out: dict = {"content": b""} if "content" in reads else {}
        if reads and f.length:
            with store.open_input_file(opened(f.path)[1]) as stream:
                if "directory" in reads:
                    out["directory"] = directory(f.length, lambda start, n: stream.read_at(n, start))
                if "content" in reads:
                    out["content"] = stream.read_at(f.length, 0)
        return out

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], ARROW[c]) for c in self.columns], self.columns)


TESTS = {
    "=": lambda x, y: x == y,
    "in": lambda x, y: x in y,
    "<": lambda x, y: x < y,
    "<=": lambda x, y: x <= y,
    ">": lambda x, y: x > y,
    ">=": lambda x, y: x >= y,
    "ends": lambda x, y: x.endswith(y),
    "starts": lambda x, y: x.startswith(y),
}


def listed(path: str) -> Iterator[File]:
    """The files below a folder; names that begin with a dot or an underscore, in any folder below, are not data, as in Spark's scans."""
    from pyarrow import fs

    store, base = opened(path.rstrip("/") or "/")
    prefix = path.rstrip("/")[: len(path.rstrip("/")) - len(base)]
    top = store.get_file_info(base)
    found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    for info in found:
        inner = info.path[len(base) :] if info is not top else ""
        if info.type == fs.FileType.File and not any(part.startswith((".", "_")) for part in inner.split("/")):
            name = posixpath.basename(info.path)
            extension = posixpath.splitext(name)[1].lower()
            yield File(prefix + info.path, name, extension, info.size, int((info.mtime_ns or 0) // 1000))


def packed(files: list[File], cost, most: int) -> list[list[File]]:
    """Files, the longest first, in as few tasks as first-fit finds; the open tasks are looked at from the fullest on in a bounded window."""
    tasks: list[list[File]] = []
    room: list[tuple[int, list[File]]] = []
    for f in files:
        need = cost(f)
        for k, (left, task) in enumerate(room):
            if need <= left and len(task) < TASK_FILES:
                task.append(f)
                room[k] = (left - need, task)
                break
        else:
            tasks.append([f])
            room.append((most - need, tasks[-1]))
            if len(room) > 64:  # the fullest one is closed
                room.remove(min(room, key=lambda r: r[0]))
    return tasks


def document_files(spark: SparkSession, folder: str, columns: str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The files below folder. columns: those of SCHEMA that are wanted (a schema string); what is not named is not read. Filters on name, path, extension and length reach the planning."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFiles)
    reader = spark.read.format("document_files").option("taskBytes", task_bytes)
    return (reader.schema(columns) if columns else reader).load(folder)
