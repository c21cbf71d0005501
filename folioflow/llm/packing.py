"""Packing documents into windows by the sum-of-squares rule.

Each task packs its own partition online. A level array holds how many windows are
filled to each level; a document goes to the level that makes the sum of the squared
counts of partially filled windows smallest (or into a new window). A document longer
than a window fills whole windows first. Windows leave memory when they are full. If more
than ``max_open`` windows are open, and at the end, the open ones are settled: the
emptiest are cut to fill the fullest, so at most one partial window is left a task, and
its rest is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, bpe

WINDOW = 2048
END_ID = 1
MAX_OPEN = 4096
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
PIECE_NAMES = [x.split()[0] for x in PIECES.split(", ")]


class Encoder:
    """Ids of a byte-level BPE vocabulary, by a compiled encoder over the same merges; what it cannot take goes to Bpe."""

    def __init__(self, path: str):
        self.slow = bpe(path)
        ranks = {b: i for b, i in self.slow.id_of.items()}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.slow.split is None or not self.slow.split.search(text):
            try:
                return self.fast.encode_to_numpy(text)
            except BaseException as e:  # the encoder's own panic is no Exception; whatever else happened is raised again
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
        return np.array(self.slow.encode(text), dtype=np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Windows of one task. add() and settle() return finished pieces (document key, start, ids, document tokens, sequence, offset)."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN, first: int = 0):
        self.window, self.max_open, self.next = window, max_open, first
        self.count = np.zeros(window + 1, dtype=np.int64)  # the level array; 0 and window stay 0
        self.at: dict[int, list[list]] = {}  # level -> its windows, each a list of pieces
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level at which a piece of this size adds least to the sum of squares; 0 opens a window. Ties go to the fullest."""
        n, count = self.window, self.count
        top = n - size
        best, level = 2 * int(count[size]) + 1, 0
        if top > 1:
            here = count[1:top]
            found = np.flatnonzero(here)
            if len(found):
                change = 2 * (count[found + 1 + size] - here[found]) + 2
                k = len(change) - 1 - int(np.argmin(change[::-1]))
                if change[k] <= best:
                    best, level = int(change[k]), int(found[k]) + 1
        if count[top] and 1 - 2 * int(count[top]) <= best:
            level = top
        return level

    def close(self, pieces: list) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1
        return out

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        out, total, n = [], len(ids), self.window
        whole = total - total % n
        for start in range(0, whole, n):
            out += self.close([(doc, start, ids[start : start + n], total)])
        if size := total - whole:
            level = self.level_for(size)
            pieces = []
            if level:
                pieces = self.at[level].pop()
                self.count[level] -= 1
                self.open -= 1
            pieces.append((doc, whole, ids[whole:].copy(), total))
            if level + size == n:
                out += self.close(pieces)
            else:
                self.at.setdefault(level + size, []).append(pieces)
                self.count[level + size] += 1
                self.open += 1
                if self.open > self.max_open:
                    out += self.settle(last=False)
        return out

    def settle(self, last: bool = True) -> list[tuple]:
        """Cut the emptiest open windows into the gaps of the fullest, until one is open; at last close that one too, in powers of two."""
        queue = [(level, pieces) for level in sorted(self.at) for pieces in self.at[level]]
        self.at, self.open = {}, 0
        self.count[:] = 0
        out: list[tuple] = []
        low = 0
        loose: list[tuple] = []  # pieces of the window that is being cut up
        level, pieces = 0, []
        while low < len(queue) or loose:
            if not pieces and low < len(queue):
                level, pieces = queue.pop()
            while level < self.window and (loose or low < len(queue)):
                if not loose:
                    loose = queue[low][1][::-1]
                    low += 1
                doc, start, ids, total = loose.pop()
                room = self.window - level
                if len(ids) > room:
                    loose.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                pieces.append((doc, start, ids, total))
                level += len(ids)
            if level < self.window:
                break
            out += self.close(pieces)
            level, pieces = 0, []
        if pieces and not last:
            self.at, self.open = {level: [pieces]}, 1
            self.count[level] = 1
        elif pieces:
            power = 1 << (level.bit_length() - 1)
            part, room = [], power
            while pieces:
                doc, start, ids, total = pieces.pop(0)
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], total))
                    ids = ids[:room]
                part.append((doc, start, ids, total))
                level, room = level - len(ids), room - len(ids)
                if not room:
                    out += self.close(part)
                    part = []
                    room = 1 << (level.bit_length() - 1) if level else 0
        return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows PIECES: where each run of a document's ids (with the end id) lies.

    A null or empty text is one end id. Repeated rows are packed as often as they occur;
    an empty table gives no rows. Partitions are packed apart, with sequence ids that
    begin at the partition's number times 2**32, so that no row is moved and a lost task
    is packed anew as it was. Other columns of ``docs`` are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(window, max_open, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            done: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                got = packer.add(doc, np.concatenate([encode(text.as_py()), end]))
                done += got
                size += sum(len(x[2]) for x in got)
                if size > 1 << 20:
                    yield pieces(done)
                    done, size = [], 0
            yield pieces(done)
        yield pieces(packer.settle())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(rows, PIECES)


def pieces(done: list[tuple]) -> pa.RecordBatch:
    """PIECES; ids of documents stay integers, also beside null ids."""
    doc, start, ids, total, sequence, offset = zip(*done, strict=True) if done else [()] * 6
    long = lambda values: pa.array(values, pa.int64())
    return pa.RecordBatch.from_arrays([long(doc), long(start), long([len(x) for x in ids]), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), long(total), long(sequence), long(offset)], PIECE_NAMES)
