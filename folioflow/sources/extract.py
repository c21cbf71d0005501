"""The one stage that reads document bytes: a row of content in, a row of items out."""

from __future__ import annotations

import contextlib
import os
import pickle
import select
import subprocess
import sys
import time
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from .items import EXTRACT, Extract


class Child:
    """An interpreter that parses documents one after the other and can be ended: Spark ends tasks, not rows. A new interpreter and no fork, as workers have threads."""

    #: documents after which a child is replaced, so that what parsers leave behind stays bounded
    MOST = 1000

    def __init__(self) -> None:
        root = str(Path(__file__).resolve().parents[2])
        env = os.environ | {"PYTHONPATH": os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])}
        self.process = subprocess.Popen([sys.executable, "-m", f"{__package__}.child"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env)
        self.done = self.waiting = 0  # documents that it was given, and those that it has yet to answer
        self.held = bytearray()
        self.read(time.monotonic() + START_SECONDS)  # it says that it is there, so a document's time is its own

    def read(self, until: float) -> bytes:
        """One message. TimeoutError if it isn't there in time, EOFError if there is no child any more."""
        pipe = self.process.stdout.fileno()
        poll = select.poll()
        poll.register(pipe, select.POLLIN)
        while len(self.held) < 8 or len(self.held) < 8 + int.from_bytes(self.held[:8], "little"):
            left = until - time.monotonic()
            if left <= 0 or not poll.poll(left * 1000):
                raise TimeoutError
            part = os.read(pipe, 1 << 16)
            if not part:
                raise EOFError
            self.held += part
        end = 8 + int.from_bytes(self.held[:8], "little")
        body = bytes(self.held[8:end])
        del self.held[:end]
        return body

    def send(self, documents: list[tuple[str, bytes]], limits: Limits) -> None:
        """Kinds and contents, which it reads whole before it answers for the first."""
        message = pickle.dumps((documents, limits), protocol=5)
        self.done += len(documents)
        self.waiting += len(documents)
        self.process.stdin.write(len(message).to_bytes(8, "little"))
        self.process.stdin.write(message)
        self.process.stdin.flush()

    def answer(self, kind: str, limits: Limits) -> Extract:
        """What became of the next document."""
        found = pickle.loads(self.read(time.monotonic() + (limits.word_timeout if kind == "docx" else limits.child_timeout)))
        self.waiting -= 1
        return found

    def end(self) -> None:
        """Asks it to go, and makes it go after five seconds."""
        self.process.terminate()
        try:
            self.process.wait(5)
        except subprocess.TimeoutExpired:
            self.process.kill()
            self.process.wait()
        for pipe in (self.process.stdin, self.process.stdout):
            with contextlib.suppress(OSError):  # what was still to be sent has nobody to read it
                pipe.close()


#: Seconds that a child has to start.
START_SECONDS = 120
#: Documents that leave in one batch, at most, and the bytes of them and of their media that end one.
TOGETHER, TOGETHER_BYTES = 64, 1 << 20
#: This worker's child, kept from document to document.
_child: list[Child] = []


def together(documents: list[tuple[str, bytes]], limits: Limits) -> Iterator[Extract]:
    """What becomes of documents (kind, content) in the worker's child, with a time limit for each whatever its size.

    They are sent together, so that the child goes on while its answers are taken. One that overstays or dies is replaced for the documents after
    the one it was at, and so is one that a task left before it had all answers.
    """
    at = 0
    while at < len(documents):
        if not _child or _child[0].done >= Child.MOST or _child[0].waiting:
            for old in _child:
                old.end()
            _child[:] = [Child()]
        child = _child[0]
        try:
            child.send(documents[at:], limits)
            while child.waiting:
                found = child.answer(documents[at][0], limits)
                at += 1
                yield found
        except (TimeoutError, EOFError, BrokenPipeError) as e:
            _child.remove(child)
            child.end()
            at += 1
            yield Extract(error_code="CONVERSION_TIMEOUT" if isinstance(e, TimeoutError) else "CONVERSION_FAILED")


def isolated(kind: str, content: bytes, limits: Limits) -> Extract:
    """The same for one document."""
    return next(together([(kind, content)], limits))


def parsed(batch: pa.RecordBatch, limits: Limits) -> Iterator[tuple[int, Extract]]:
    """The length of each document without an error, and what becomes of it; as many go to the child together as leave together."""
    lot: list[tuple[str, bytes]] = []
    size = 0
    left = [i for i, code in enumerate(batch.column("error_code").to_pylist()) if code is None]
    for i in left:
        lot.append((batch.column("source_type")[i].as_py(), batch.column("content")[i].as_py() or b""))
        size += len(lot[-1][1])
        if len(lot) == TOGETHER or size >= TOGETHER_BYTES or i == left[-1]:
            yield from zip([len(content) for _, content in lot], together(lot, limits), strict=False)
            lot, size = [], 0


def extracted(files: DataFrame, limits: Limits) -> DataFrame:
    """path, source_type, error_code, parts, items from path, source_type, error_code, content; only rows without an error are opened, in a process that can be ended."""
    schema = f"path string, source_type string, {EXTRACT}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[Extract] = []
            begun = size = 0
            answers = parsed(batch, limits)
            for i, code in enumerate(batch.column("error_code").to_pylist()):
                if code is None:
                    length, found = next(answers)
                    held.append(found)
                    size += length + sum(len(x.content or b"") for x in found.items)
                else:
                    held.append(Extract(error_code=code))
                # small documents leave together: a batch costs about as much as parsing one of them
                if len(held) == TOGETHER or size >= TOGETHER_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("path").slice(begun, len(held)),
                            batch.column("source_type").slice(begun, len(held)),
                            pa.array([g.error_code for g in held], pa.string()),
                            pa.array([g.parts for g in held], pa.int32()),
                            pa.array([[x.row() for x in g.items] for g in held], ITEMS),
                        ],
                        ["path", "source_type", "error_code", "parts", "items"],
                    )
                    begun, size, held = i + 1, 0, []

    # what failed before does not travel
    return files.select("path", "source_type", "error_code", F.when(F.col("error_code").isNull(), F.col("content")).alias("content")).mapInArrow(rows, schema)


ITEMS = pa.list_(
    pa.struct(
        [
            ("part_no", pa.int32()),
            ("place", pa.int32()),
            ("key", pa.list_(pa.int64())),
            ("kind", pa.string()),
            ("text", pa.string()),
            ("paragraphs", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))),
            ("rows", pa.list_(pa.list_(pa.string()))),
            ("ext", pa.string()),
            ("alt", pa.string()),
            ("position", pa.int32()),
            ("boxes", pa.list_(pa.struct([("w", pa.float64()), ("h", pa.float64())]))),
            ("area", pa.float64()),
            ("digest", pa.string()),
            ("content", pa.binary()),
        ]
    )
)
