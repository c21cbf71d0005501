"""Hard-negative mining: exact inner products found through an orthogonal rotation.

All rows are turned by one orthogonal matrix, whose first directions hold most of the
vectors' energy (principal components of a bounded sample). Inner products stay as they are, so the
products of the leading components plus or minus the product of the two remainders' norms
(Cauchy-Schwarz) enclose the score. Pairs whose interval shows that they can't be among the answers
are discarded after a few components, more components narrow the interval of the rest, and
survivors get their integer product. A slack covers every rounding of the floating-point part, so
what is discarded is discarded rightly, and the results are those of brute force.

Rows are packed into blocks once, where they lie. Anchors (a stated share of the rows) are sent
to the blocks in groups of bounded size; each task keeps the best few candidates for each anchor, and only these are
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block, and anchors that meet a block at a time.
BLOCK, TILE = 8_192, 512
#: Rows that are turned into integers at a time.
SLICE = 2_048
#: Bytes of the anchors of a group (their vectors twice, as integers and rotated).
GROUP_BYTES = 1 << 25
#: Pairs whose components are gathered at a time.
GATHER = 1 << 17
#: Rows from which the rotation is fitted; it decides the speed only.
SAMPLE = 20_000
#: Shares of the energy after whose components intervals are compared.
SHARES = (0.4, 0.6, 0.8)
#: Candidates per anchor that are verified first to learn a threshold.
FIRST = 8
LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 3
    #: percentages of the positive's score between which a negative's lies
    low: int = 50
    high: int = 95
    #: components become floor(scale * x)
    scale: int = 256


@dataclass
class Block:
    """Rows by label: row numbers, ids, labels, integer vectors, rotated vectors, norms of what is left after each cut."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    ints: np.ndarray
    turned: np.ndarray
    left: np.ndarray

    def part(self, at: slice | np.ndarray) -> Block:
        return Block(self.row[at], self.id[at], self.label[at], self.ints[at], self.turned[at], self.left[:, at])


class Rotation:
    """An orthogonal matrix, the numbers of components after which pairs are compared, and the slack for a pair of unit norms."""

    def __init__(self, sample: np.ndarray, dim: int):
        moments = sample.T.astype(np.float64) @ sample if len(sample) else np.eye(dim)
        energy, self.matrix = np.linalg.eigh(moments / max(1.0, float(np.abs(moments).max())))
        self.matrix, energy = np.ascontiguousarray(self.matrix[:, ::-1]), np.maximum(energy[::-1], 0)
        share = np.cumsum(energy) / max(energy.sum(), 1e-300)
        self.cuts = sorted({min(dim, int(np.searchsorted(share, s)) + 1) for s in SHARES})
        # float32 rounding of both vectors and of at most dim products and sums, float64 rounding of the turn, how far the matrix is from orthogonal
        defect = np.abs(self.matrix.T @ self.matrix - np.eye(dim)).sum()
        self.slack = (2 * dim + 16) * 2.0**-23 + 4 * defect

    def block(self, row: np.ndarray, id_: np.ndarray, label: np.ndarray, ints: np.ndarray) -> Block:
        whole = ints.astype(np.float64) @ self.matrix
        squares = whole**2
        left = np.sqrt(np.stack([squares[:, c:].sum(axis=1) for c in self.cuts] + [squares.sum(axis=1)]))
        return Block(row, id_, label, ints, whole.astype(np.float32), left)

    def between(self, a: Block, r: Block, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (numbers in a, in r) whose score may lie in [least, most] of their anchor; all that do are among them."""
        first = self.cuts[0]
        score = a.turned[:, :first] @ r.turned[:, :first].T
        room = np.outer(a.left[0], r.left[0]) + self.slack * np.outer(a.left[-1], r.left[-1]) + 1.0
        x, y = np.nonzero((score + room >= least[:, None]) & (score - room <= most[:, None]))
        found = score[x, y].astype(np.float64)
        for k, (begin, end) in enumerate(zip(self.cuts, self.cuts[1:], strict=False), 1):
            keep = np.empty(len(x), dtype=bool)
            for at in range(0, len(x), GATHER):
                s = slice(at, at + GATHER)
                found[s] += np.einsum("ij,ij->i", a.turned[x[s], begin:end], r.turned[y[s], begin:end])
                narrow = a.left[k][x[s]] * r.left[k][y[s]] + self.slack * a.left[-1][x[s]] * r.left[-1][y[s]] + 1.0
                keep[s] = (found[s] + narrow >= least[x[s]]) & (found[s] - narrow <= most[x[s]])
            x, y, found = x[keep], y[keep], found[keep]
        return x, y


def exact(a: Block, r: Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer products of pairs."""
    out = np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), GATHER):
        s = slice(at, at + GATHER)
        out[s] = np.einsum("ij,ij->i", a.ints[x[s]].astype(np.int64), r.ints[y[s]].astype(np.int64))
    return out


class Best:
    """The best ``size`` candidates of each of ``n`` lists: highest score, then smallest id."""

    def __init__(self, n: int, size: int):
        self.size, self.n = size, n
        self.of, self.score, self.id, self.row = (np.empty(0, dtype=np.int64) for _ in range(4))
        #: the score below which a candidate is of no use to its list
        self.bar = np.full(n, LEAST)

    def add(self, of: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        if not len(of):
            return
        of, score, id_, row = (np.concatenate(x) for x in ((self.of, of), (self.score, score), (self.id, id_), (self.row, row)))
        order = np.lexsort((row, id_, -score, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of, side="left")
        kept = order[place < self.size]
        self.of, self.score, self.id, self.row = of[place < self.size], score[kept], id_[kept], row[kept]
        full = place == self.size - 1
        self.bar[of[full]] = score[order[full]]


def mine(rows: DataFrame, anchors: Column, settings: Mining = Mining(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first negatives for every anchor and positive.

    Integer components are floor(scale * x); a row's score is its integer product with the
    anchor, higher ones first, ties by smaller id. An anchor's positives are its first other rows of the same label; a
    negative has another label and low/100 to high/100 of the positive's score. ``anchors`` tells which rows are anchors.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part. Shorter
    vectors count as followed by zeros. Repeated rows are rows of their own: a copy of
    an anchor is a positive of it, and an anchor itself. Products must fit a long, else the tasks raise
    ValueError. Empty tables and anchors without positives give no rows; other columns are not read.
    """
    spark = rows.sparkSession
    dim = rows.agg(F.max(F.size(vector_col))).first()[0]
    dim = max(1, dim or 0)  # of empty vectors the only component counts as zero
    label = F.col(label_col).cast("long")
    packed = cut(rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor")).mapInArrow(packing(dim, settings.scale), "block long, anchor boolean, n int, row binary, id binary, label binary, ints binary"), "hard-negatives-rows")
    blocks, queries = packed.where("NOT anchor"), packed.where("anchor")
    rotation = Rotation(sample(blocks, dim), dim)
    n = queries.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-2 * n * dim * 8 // GROUP_BYTES))
    queries = queries.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    made = []
    for group in range(groups):
        found = [unpacked(r, dim) for r in queries.where(F.col("group") == group).select("n", "row", "id", "label", "ints").collect()]
        if not found:
            continue
        a = rotation.block(*(np.concatenate(x) for x in zip(*found, strict=True)))
        order = np.argsort(a.label, kind="stable")
        sent = spark.sparkContext.broadcast((rotation, a.part(order)))
        best = blocks.mapInArrow(positives(sent, dim, settings), "anchor_row long, anchor_id long, row long, id long, score long")
        first = Window.partitionBy("anchor_row").orderBy(F.col("score").desc(), "id", "row")
        best = cut(best.withColumn("place", F.row_number().over(first)).where(F.col("place") <= settings.positives), "hard-negatives-positives", slim=True)
        known = best.select("anchor_row", "place", "score").collect()  # as many as a group's anchors times settings.positives
        scores = np.full((len(a.row), settings.positives), -1, dtype=np.int64)  # a negative score admits no negative, nor does none
        at = {int(r): i for i, r in enumerate(a.row[order])}
        for r in known:
            scores[at[r["anchor_row"]], r["place"] - 1] = r["score"]
        caps = spark.sparkContext.broadcast(scores)
        worst = blocks.mapInArrow(negatives(sent, caps, dim, settings), "anchor_row long, place int, row long, id long, score long")
        first = Window.partitionBy("anchor_row", "place").orderBy(F.col("score").desc(), "id", "row")
        worst = worst.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= settings.negatives)
        pairs = best.select("anchor_row", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        made.append(pairs.join(worst, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not made:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def packing(dim: int, scale: int):
    """Rows as blocks of integers; anchors once more, as blocks of their own."""
    most = int(np.sqrt((2.0**62) / max(1, dim)))

    def integers(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls as NaN
        out = np.zeros((len(vectors), dim))
        out[np.arange(dim) < lengths[:, None]] = values
        good = np.isfinite(out).all(axis=1) & pc.is_valid(vectors).to_numpy(zero_copy_only=False)
        out = np.floor(scale * out[good])
        if out.size and np.abs(out).max() > min(most, 2**31 - 1):
            raise ValueError("the products of these vectors do not fit a long")
        return good, out.astype(np.int32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        seen = blocks = 0
        waiting: dict[bool, list] = {False: [], True: []}

        def out(anchor: bool) -> pa.RecordBatch:
            nonlocal blocks
            row, id_, label, ints = (np.concatenate(x) for x in zip(*waiting[anchor], strict=True))
            waiting[anchor] = []
            order = np.argsort(label, kind="stable")
            blocks += 1
            values = [task + blocks, anchor, len(row), *(x[order].tobytes() for x in (row, id_, label, ints))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.bool_(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["block", "anchor", "n", "row", "id", "label", "ints"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                part = part.filter(pc.and_(pc.is_valid(part.column("id")), pc.is_valid(part.column("label"))))
                if not part.num_rows:
                    continue
                good, ints = integers(part.column("vector"))
                id_, label, anchor = (part.column(c).to_numpy(zero_copy_only=False)[good] for c in ("id", "label", "anchor"))
                row = task + seen + np.arange(len(id_))
                seen += len(id_)
                for kind, mask in ((False, np.ones(len(id_), dtype=bool)), (True, anchor.astype(bool))):
                    if mask.any():
                        waiting[kind].append((row[mask], id_[mask].astype(np.int64), label[mask].astype(np.int64), ints[mask]))
                    if sum(len(x[0]) for x in waiting[kind]) >= BLOCK:
                        yield out(kind)
        for kind in waiting:
            if waiting[kind]:
                yield out(kind)

    return pack


def unpacked(r, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, id_, label = (np.frombuffer(r[c], dtype=np.int64) for c in ("row", "id", "label"))
    return row, id_, label, np.frombuffer(r["ints"], dtype=np.int32).reshape(len(row), dim)


def sample(blocks: DataFrame, dim: int) -> np.ndarray:
    """At most SAMPLE rows: an equal share of each of some blocks, in an order of their numbers' hashes."""
    chosen = blocks.select("n", "ints", F.xxhash64("block").alias("h")).orderBy("h").limit(64)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(x, dtype=np.int32).reshape(-1, dim)[:: max(1, -(-n * 64 // SAMPLE))].tobytes() for n, x in zip(batch.column("n").to_pylist(), batch.column("ints").to_pylist(), strict=True)], pa.binary())], ["ints"])

    parts = [np.frombuffer(r["ints"], dtype=np.int32).reshape(-1, dim) for r in chosen.mapInArrow(share, "ints binary").collect()]
    return np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, dim))


def blocks_of(batches: Iterator[pa.RecordBatch], rotation: Rotation, dim: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield rotation.block(*unpacked({c: batch.column(c)[i].as_py() for c in ("row", "id", "label", "ints")}, dim))


def same(labels: np.ndarray, label: int) -> slice:
    return slice(int(np.searchsorted(labels, label, "left")), int(np.searchsorted(labels, label, "right")))


def positives(sent, dim: int, settings: Mining):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, anchors = sent.value
        best = Best(len(anchors.row), settings.positives)
        for block in blocks_of(batches, rotation, dim):
            for label in np.intersect1d(anchors.label, block.label):
                own, r = same(anchors.label, label), block.part(same(block.label, label))
                for begin in range(own.start, own.stop, TILE):
                    at = slice(begin, min(own.stop, begin + TILE))
                    a, numbers = anchors.part(at), np.arange(at.start, at.stop)
                    if len(r.row) > 4 * (settings.positives + FIRST):  # those that look best first, for a bar
                        k = rotation.cuts[-1]
                        look = np.argpartition(-(a.turned[:, :k] @ r.turned[:, :k].T), FIRST + settings.positives, axis=1)[:, : FIRST + settings.positives]
                        x, y = np.repeat(np.arange(len(a.row)), look.shape[1]), look.ravel()
                        x, y = x[a.row[x] != r.row[y]], y[a.row[x] != r.row[y]]
                        trial = Best(len(a.row), settings.positives)
                        trial.add(x, exact(a, r, x, y), r.id[y], r.row[y])
                        bar = np.maximum(best.bar[at], trial.bar)
                    else:
                        bar = best.bar[at]
                    x, y = rotation.between(a, r, bar.astype(np.float64), np.full(len(a.row), np.inf))
                    other = a.row[x] != r.row[y]
                    x, y = x[other], y[other]
                    score = exact(a, r, x, y)
                    keep = score >= bar[x]
                    best.add(numbers[x[keep]], score[keep], r.id[y[keep]], r.row[y[keep]])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchors.row[best.of], anchors.id[best.of], best.row, best.id, best.score)], ["anchor_row", "anchor_id", "row", "id", "score"])

    return run


def negatives(sent, caps, dim: int, settings: Mining):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, anchors = sent.value
        scores = caps.value
        # the integer scores that a positive admits: low * p <= 100 * s <= high * p
        admits = scores >= 0
        hundreds, rest = scores // 100, scores % 100  # so that no product overflows
        least = np.where(admits, settings.low * hundreds - (-settings.low * rest // 100), 1)
        most = np.where(admits, settings.high * hundreds + settings.high * rest // 100, 0)
        width = scores.shape[1]
        best = Best(scores.size, settings.negatives)
        for block in blocks_of(batches, rotation, dim):
            for begin in range(0, len(anchors.row), TILE):
                at = slice(begin, min(len(anchors.row), begin + TILE))
                a = anchors.part(at)
                # no use below the bar of each list, nor above what any positive admits
                for piece in range(0, len(block.row), BLOCK // 8):  # so that bars rise early
                    r = block.part(slice(piece, piece + BLOCK // 8))
                    bar = np.maximum(least[at], best.bar.reshape(-1, width)[at])
                    low = np.where(bar <= most[at], bar, np.iinfo(np.int64).max).min(axis=1).astype(np.float64)
                    x, y = rotation.between(a, r, low, most[at].max(axis=1).astype(np.float64))
                    other = a.label[x] != r.label[y]
                    x, y = x[other], y[other]
                    score = exact(a, r, x, y)
                    for place in range(width):
                        fits = np.nonzero((score >= bar[x, place]) & (score <= most[at][x, place]))[0]
                        best.add((begin + x[fits]) * width + place, score[fits], r.id[y[fits]], r.row[y[fits]])
        anchor, place = best.of // width, best.of % width + 1
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchors.row[anchor], place.astype(np.int32), best.row, best.id, best.score)], ["anchor_row", "place", "row", "id", "score"])

    return run
