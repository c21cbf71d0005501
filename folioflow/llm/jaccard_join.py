"""N-gram Jaccard join by chosen paths.

Texts are sets of word shingles. Texts with the same set form one class, which is what
is joined. A class has 64 marks, the tokens of its set that come first under 64 orders: two
classes have the same mark with a probability of their similarity. A run deals the classes
into a tree: a node chooses ``fan`` orders at random, and a class goes to one child for
each, named by its mark there. Nodes of at most ``leaf`` classes are compared by brute
force. In a larger node everything is compared with a random pivot. Classes with at least
half of the pivot's marks, its core, leave the node, which so falls apart also where all
are alike. They are compared before they go: the number of different marks is a metric, so whatever
differs from one of the core in at most ``apart`` marks is in the pivot's ball, the
classes that differ from the pivot in at most half of the marks plus ``apart``. The
core is compared with the whole ball, and nothing is lost by leaving. The rest is split
further, by the same rule at every depth. Runs are repeated until the target recall.

What is similar by its marks becomes a link of a candidate graph, of which first only a
spanning forest is written. Only candidates are ever compared with whole sets:

* A component that fits into a task is one cell. Its classes meet there once, and pairs that differ in more marks
  than any link does are passed over.
* In a larger component the cells of the trees are looked at again. Classes with few candidates in each cell are
  sparse; pairs of two sparse classes are written, and verified star by star. The others are dense: what they are
  candidates with falls into components of its own, which are compared block by block, pairs of sparse classes left out.

So a chain costs as many comparisons as it has candidates, while a group of copies that are all alike costs its
pairs once, and these are never written. Tasks return counts and forests.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_into, folder, private, shared_dir
from .components import components

COORDINATES = 64


@dataclass(frozen=True)
class Join:
    """words: of a shingle. least: the similarity of a link. recall: the share of links, just as similar as that, that is to be found.
    fan: orders that a node chooses. leaf: the most classes that are compared by brute force at once. core: the most marks in which
    a core differs from its pivot. Groups are compared in blocks: cell and large_cell classes (by marks), block and
    large_block classes, and at most block_shingles shingles (exactly); the larger ones once there are enough of the smaller to keep many tasks busy.
    sparse: the most candidates in a cell of a class whose pairs are written.
    """

    words: int = 5
    least: float = 0.8
    recall: float = 0.9995
    fan: int = 2
    leaf: int = 256
    core: int = COORDINATES // 2
    cell: int = 1024
    large_cell: int = 4096
    block: int = 128
    large_block: int = 1024
    block_shingles: int = 1 << 21
    sparse: int = 12

    @property
    def apart(self) -> int:
        """The most marks in which a link's ends may differ: under one in 10,000 links of the least similarity differ in more."""
        return self.exceeded(1e-4)

    @property
    def sure(self) -> int:
        """The same for candidates that have met: under one in 100 million links differ in more."""
        return self.exceeded(1e-8)

    def exceeded(self, chance: float) -> int:
        left, m = 1.0, -1
        while left > chance and m < COORDINATES:
            m += 1
            left -= math.comb(COORDINATES, m) * (1 - self.least) ** m * self.least ** (COORDINATES - m)
        return m

    def found(self, runs: int) -> float:
        """The least probability that a link of the least similarity is found by so many runs.

        A link's ends with a share s of equal marks go on together into each of a node's
        ``fan`` children with a probability of s. That all these lines die out, in a tree of any
        depth, has at most the probability that solves q = (1 - s + s * q) ** fan.
        """
        total = 0.0
        for m in range(self.apart + 1):
            s = 1 - m / COORDINATES
            lost = extinct(s, self.fan)
            total += math.comb(COORDINATES, m) * (1 - self.least) ** m * self.least ** (COORDINATES - m) * (1 - lost**runs)
        return total

    @property
    def runs(self) -> int:
        """The fewest runs that reach the recall; the chance that marks mislead about a link bounds what can be asked for."""
        runs = 1
        while self.found(runs) < self.recall:
            runs += 1
            if runs > 64:
                raise ValueError("this recall cannot be reached")
        return runs


def extinct(s: float, fan: int) -> float:
    """The probability that a line that goes on with probability s into each of fan children dies out, from below."""
    q = 0.0
    for _ in range(10_000):
        q = (1 - s + s * q) ** fan
    return q


class WordHash(dict):
    """word -> 64-bit hash, remembered; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles(text: str, words: int, table: WordHash) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; a shorter text is one shingle, a text without words has none."""
    parts = text.split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(table.__getitem__, parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        total *= ODD[(j + 1) % len(ODD)]
        total ^= h[j : j + n]
        total += total >> np.uint64(29)
    total *= ODD[0]
    total ^= total >> np.uint64(32)
    return np.unique(total)


def orders() -> np.ndarray:
    """One odd multiplier per coordinate, from a fixed seed."""
    return np.random.default_rng(20240229).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(found: np.ndarray, multipliers: np.ndarray) -> bytes:
    """COORDINATES 16-bit marks of the tokens that come first."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(best, (found[at : at + 2048, None] * multipliers).min(axis=0), out=best)
    return (best * ODD[2] >> np.uint64(48)).astype("<u2").tobytes()


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, d (digest of the set; null without words), size, sig."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, multipliers = WordHash(), orders()
        for batch in batches:
            d, size, sig = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), words, table)
                d.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                size.append(len(found))
                sig.append(min_hashes(found, multipliers) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(d, pa.binary()), pa.array(size, pa.int32()), pa.array(sig, pa.binary())], ["doc_id", "d", "size", "sig"])

    return docs.mapInArrow(rows, "doc_id long, d binary, size int, sig binary")


def marks(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, COORDINATES)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row it is connected to by the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (before == label).all():
            break
    return label


def groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The whole groups of rows with the same key, in pieces of several groups; rows come ordered by key."""
    kept: pd.DataFrame | None = None
    for batch in batches:
        kept = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        if not len(kept):
            continue
        whole = (kept[key] != kept[key].iloc[-1]).any(axis=1).to_numpy()  # the last group may go on
        if whole.any():
            yield kept[whole].reset_index(drop=True)
            kept = kept[~whole].reset_index(drop=True)
    if kept is not None and len(kept):
        yield kept


def tree(k: np.ndarray, one: list[np.ndarray], two: list[np.ndarray]) -> pd.DataFrame:
    """a, b: a spanning forest of the links between rows (one, two) of the classes k."""
    if not one:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    label = forest(len(k), np.concatenate(one), np.concatenate(two))
    child = np.flatnonzero(label != np.arange(len(k)))
    return pd.DataFrame({"a": k[child], "b": k[label[child]]}).drop_duplicates()


def told_apart(k: np.ndarray, one: list[np.ndarray], two: list[np.ndarray], most: int) -> pd.DataFrame:
    """a, b, dense: the pairs of rows with at most ``most`` links each; of the others a spanning forest, and each row with more links as a loop, both dense."""
    if not one:
        return pd.DataFrame({"a": np.empty(0, "int64"), "b": np.empty(0, "int64"), "dense": np.empty(0, "bool")})
    i, j = np.concatenate(one), np.concatenate(two)
    i, j = i[i != j], j[i != j]
    i, j = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1) if len(i) else (i, j)
    many = np.bincount(np.concatenate([i, j]), minlength=len(k)) > most
    few = ~(many[i] | many[j])
    rest = tree(k, [i[~few]], [j[~few]])
    loops = k[np.flatnonzero(many)]
    pairs = pd.DataFrame({"a": np.minimum(k[i[few]], k[j[few]]), "b": np.maximum(k[i[few]], k[j[few]]), "dense": False})
    return pd.concat([pairs, rest.assign(dense=True), pd.DataFrame({"a": loops, "b": loops, "dense": True})], ignore_index=True).astype({"a": "int64", "b": "int64", "dense": "bool"})


def compare_leaves(leaves: DataFrame, apart: int, sparse: int | None = None) -> DataFrame:
    """Links a, b (a spanning forest of each bucket) of what is similar by its marks; buckets are whole in their task, rows ordered by path. sparse: what told_apart() makes of them instead."""

    def links(block: pd.DataFrame) -> pd.DataFrame:
        path, sig = block["path"].to_numpy(), marks(block["sig"])
        one, two = [], []
        i, lag = np.arange(len(path)), 1
        while len(i):
            i = i[i + lag < len(path)]
            i = i[path[i] == path[i + lag]]
            for at in range(0, len(i), 1 << 16):
                a = i[at : at + (1 << 16)]
                a = a[(sig[a] != sig[a + lag]).sum(axis=1) <= apart]
                one.append(a)
                two.append(a + lag)
            lag += 1
        k = block["k"].to_numpy()
        if sparse is None:
            return tree(k, one, two)
        # a class may be in several buckets of a piece, and its links are counted by bucket
        at = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        one, two = (np.concatenate(x) if x else np.empty(0, "int64") for x in (one, two))
        by = np.searchsorted(at, one, "right")
        order = np.argsort(by, kind="stable")
        edges = np.searchsorted(by[order], np.arange(len(at) + 2))
        found = [told_apart(k, [one[order[x:y]]], [two[order[x:y]]], sparse) for x, y in zip(edges, edges[1:], strict=False) if y > x]
        return pd.concat(found, ignore_index=True) if found else told_apart(k, [], [], sparse)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in groups(batches, ["path"]):
            yield links(block)

    return leaves.select("path", "k", "sig").repartition("path").sortWithinPartitions("path").mapInPandas(rows, "a long, b long" + ", dense boolean" * (sparse is not None))


def parts(n: Column, size: int, large: int, many: int) -> Column:
    """Blocks of n rows: of ``size`` rows up to ``many`` blocks, then as few as blocks of ``large`` rows allow, so copies grow slowly."""
    return F.greatest(F.least(F.ceil(n / size), F.lit(many)), F.ceil(n / large)).cast("int")


def compare_cores(balls: DataFrame, p: Join, sparse: int | None = None) -> DataFrame:
    """Links a, b (a spanning forest of each cell) between the cores of balls (path, k, sig, core) and what is in them.

    A ball is dealt into cells of some of its core and some of the ball, so
    neither a core nor a ball has to fit into a task; a core of one part is copied to the parts of
    its ball, which are not copied then. sparse: what told_apart() makes of them instead.
    """
    blocks = lambda n: parts(n, p.cell, p.large_cell, 4)
    per = balls.groupBy("path").agg(blocks(F.count(F.when(F.col("core"), 1))).alias("cores"), blocks(F.count(F.lit(1))).alias("parts"))
    part = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    rows = balls.join(per, "path")
    inner = rows.where("core").select("path", part("cores").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(True).alias("core"), "k", "sig")
    outer = rows.select("path", F.explode(F.sequence(F.lit(0), F.col("cores") - 1)).alias("i"), part("parts").alias("j"), F.lit(False).alias("core"), "k", "sig")

    def links(cell: pd.DataFrame) -> pd.DataFrame:
        core, sig = cell["core"].to_numpy(), marks(cell["sig"])
        inside, other = np.flatnonzero(core), np.flatnonzero(~core)
        near = sig[other]
        one, two = [], []
        k, number = np.unique(cell["k"].to_numpy(), return_inverse=True)
        for i in inside:
            hit = other[(near != sig[i]).sum(axis=1) <= p.apart]
            one.append(np.full(len(hit), number[i]))
            two.append(number[hit])
        return tree(k, one, two) if sparse is None else told_apart(k, one, two, sparse)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for several in groups(batches, ["path", "i", "j"]):
            for _, cell in several.groupby(["path", "i", "j"], sort=False):
                yield links(cell)

    return inner.unionByName(outer).repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInPandas(each, "a long, b long" + ", dense boolean" * (sparse is not None))


def children(nodes: DataFrame, fan: int) -> DataFrame:
    """Each row once for every order its node chooses, at the child's path."""
    rows = nodes.withColumn("way", F.explode(F.array(*[F.lit(i) for i in range(fan)])))
    rows = rows.withColumn("at", F.pmod(F.pmod(F.xxhash64("path"), F.lit(COORDINATES)) + F.col("way") * 21, F.lit(COORDINATES)).cast("int"))
    return rows.select(F.xxhash64("path", "at", F.expr("substring(sig, at * 2 + 1, 2)")).alias("path"), "k", "sig")


def from_pivots(rows: DataFrame) -> DataFrame:
    """rows with ``off``, in how many marks they differ from the pivot's."""

    def off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.drop(columns="pivot_sig").assign(off=(marks(batch["sig"]) != marks(batch["pivot_sig"])).sum(axis=1).astype("int32"))

    return rows.mapInPandas(off, "path long, k long, sig binary, off int")


def candidate_places(classes: DataFrame, p: Join) -> tuple[DataFrame, DataFrame | None]:
    """Where classes (k, sig) meet: leaves (path, k, sig), and balls (path, k, sig, core) if any node was too large for a leaf.

    Each level's leaves are written before the next level is made, and those of all levels are read as one table: plans have
    no joins and scans for each level, so what the driver holds does not grow with the depth of the trees.
    """
    spark = classes.sparkSession
    runs = F.explode(F.array(*[F.xxhash64(F.lit(run)) for run in range(p.runs)]))
    nodes = children(classes.select(runs.alias("path"), "k", "sig"), p.fan)
    leaves, balls, level = folder(spark, "chosen-path-leaves"), folder(spark, "chosen-path-pivots"), 0
    while True:
        # at most one path in ``leaf`` rows; the row with the least hash is its pivot
        large = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("k", "path")).alias("by"))
        large = cut(large.where(F.col("n") > p.leaf).select("path", "by"), "chosen-path-large", slim=True)
        leaf = cut_into(f"{leaves}/{level}", nodes.join(large, "path", "left_anti"))
        if large.isEmpty():
            break
        pivots = nodes.withColumn("by", F.xxhash64("k", "path")).join(large, ["path", "by"]).select("path", F.col("sig").alias("pivot_sig")).dropDuplicates(["path"])
        compared = cut_into(f"{balls}/{level}", from_pivots(nodes.join(pivots, "path")), slim=True)
        nodes = children(compared.where(F.col("off") > p.core).select("path", "k", "sig"), p.fan)
        level += 1
    leaves = spark.read.schema(leaf.schema).parquet(*[f"{leaves}/{n}" for n in range(level + 1)])
    if not level:
        return leaves, None
    met = spark.read.schema(compared.schema).parquet(*[f"{balls}/{n}" for n in range(level)])
    return leaves, met.where(F.col("off") <= p.core + p.apart).select("path", "k", "sig", (F.col("off") <= p.core).alias("core"))


def candidate_links(places: tuple[DataFrame, DataFrame | None], p: Join, sparse: int | None = None) -> DataFrame:
    """Links a, b between classes that are similar by their marks (with sparse: and dense)."""
    leaves, balls = places
    links = compare_leaves(leaves, p.apart, sparse)
    if balls is not None:
        links = links.unionByName(compare_cores(balls, p, sparse))
    return cut(links.distinct(), "chosen-path-links", slim=True)


#: What verification returns for a class of a cell: links counts documents, root is the smallest digest it is connected to there, compared its comparisons with whole sets.
MET = "alone boolean, d binary, links long, root binary, compared long"


def common_shingles(each: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of some sets have in common."""
    n = len(each)
    token = np.unique(np.concatenate(each), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), [len(x) for x in each])
    often = np.bincount(token) > 1  # a shingle of one set joins nothing
    keep = often[token]
    token, owner = (np.cumsum(often) - 1)[token[keep]], owner[keep]
    width = int(often.sum())
    common = np.zeros((n, n), dtype=np.float64)
    step = max(1, (1 << 22) // max(n, 1))
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    for at in range(0, width, step):
        a, b = np.searchsorted(token, [at, at + step])
        x = np.zeros((n, min(step, width - at)), dtype=np.float32)
        x[owner[a:b], token[a:b] - at] = 1
        common += x @ x.T
    return common


def alike(a: int | np.ndarray, b: int | np.ndarray, common: int | np.ndarray, least: float) -> bool | np.ndarray:
    """Whether sets of these sizes with so much in common are similar enough."""
    return common >= least * (a + b - common) - 1e-9


def exact_links(sets: DataFrame, p: Join) -> DataFrame:
    """MET from rows (c, i, j, alone, half, dense, d, sig, weight, found): those of a cell (c, i, j) are compared with whole sets.

    In a cell of one block all its classes meet each other; in a cell of two, those of
    one half meet those of the other. Pairs of which neither is dense, and pairs that differ in more marks than links do,
    are not compared.
    """

    def cell(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("d").reset_index(drop=True)
        n = len(group)
        each = [np.frombuffer(x, dtype="<u8") for x in group["found"]]
        size = np.array([len(x) for x in each])
        sig, dense, half = marks(group["sig"]), group["dense"].to_numpy(dtype=bool), group["half"].to_numpy()
        near = np.zeros((n, n), dtype=bool)
        for i in range(n - 1):
            near[i, i + 1 :] = ((sig[i + 1 :] != sig[i]).sum(axis=1) <= p.sure) & (dense[i + 1 :] | dense[i])
        if (group["i"] != group["j"]).any():
            near &= half[:, None] != half[None, :]
        i, j = np.nonzero(near)
        if 8 * len(i) < n * n:
            common = np.array([len(np.intersect1d(each[a], each[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
        else:
            common = common_shingles(each)[i, j]
        linked = alike(size[i], size[j], common, p.least)
        weight, links = group["weight"].to_numpy(), np.zeros(n, dtype=np.int64)
        np.add.at(links, i[linked], weight[j[linked]])
        np.add.at(links, j[linked], weight[i[linked]])
        d = group["d"].to_numpy()
        return pd.DataFrame({"alone": group["alone"], "d": d, "links": links, "root": d[forest(n, i[linked], j[linked])], "compared": np.bincount(np.concatenate([i, j]), minlength=n)})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for several in groups(batches, ["c", "i", "j"]):
            for _, group in several.groupby(["c", "i", "j"], sort=False):
                yield cell(group)

    return sets.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "d").mapInPandas(rows, MET)


#: A row's place: its cell, whether that is all of its component, its half of the cell, and whether it is compared with classes that are not dense.
PLACE = ("c", "i", "j", "alone", "half", "dense")


def dealt(linked: DataFrame, p: Join) -> DataFrame:
    """PLACE and k for the classes (c, k, d, size, dense, final) of components: one cell for a small component, blocks against blocks for others."""
    per = linked.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    several = F.greatest(parts(F.col("n"), p.block, p.large_block, 128), F.ceil(F.col("total") / (p.block_shingles / 2)))
    per = per.where("n > 1").select("c", F.when(small(p), 1).otherwise(several).cast("int").alias("blocks"))
    whole = linked.join(per, "c").withColumn("half", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
    cells = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alone = F.col("final") & (F.col("blocks") == 1)
    return cells.select("c", F.least("half", "other").cast("int").alias("i"), F.greatest("half", "other").cast("int").alias("j"), alone.alias("alone"), "half", "dense", "k")


def starred(pairs: DataFrame, sizes: DataFrame, p: Join) -> DataFrame:
    """PLACE and k for pairs (a, b): a cell for each a, where it alone meets its partners; a star with many shingles is several cells."""
    per = pairs.join(sizes.withColumnRenamed("k", "b"), "b").groupBy("a").agg(F.ceil(F.sum("size") / p.block_shingles).cast("int").alias("parts"))
    members = pairs.join(per, "a").select("a", F.col("b").alias("k"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("half"))
    centres = members.select("a", F.col("a").alias("k"), "part", F.lit(0).alias("half")).distinct()
    both = members.unionByName(centres)
    return both.select(F.xxhash64(F.lit("star"), "a", "part").alias("c"), F.lit(0).alias("i"), F.lit(1).alias("j"), F.lit(False).alias("alone"), "half", F.lit(True).alias("dense"), "k")


def small(p: Join) -> Column:
    """Whether a component of n classes and total shingles fits into a task."""
    return (F.col("n") <= 2 * p.block) & (F.col("total") <= p.block_shingles)


def placed(linked: DataFrame, places: tuple[DataFrame, DataFrame | None], p: Join) -> DataFrame:
    """PLACE and k: the cells in which the classes with candidates are compared. linked: c (component), k, d, size."""
    sure = {"dense": F.lit(True), "final": F.lit(True)}
    per = linked.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    large = cut(linked.join(per.where(~small(p)).select("c"), "c", "left_semi"), "jaccard-large", slim=True)
    if large.isEmpty():
        return dealt(linked.withColumns(sure), p)
    rest = linked.join(per.where(small(p)).select("c"), "c", "left_semi").withColumns(sure)

    # the candidates of large components, once more, told apart by how many each class has
    own = large.select("k")
    again = tuple(None if x is None else x.join(own, "k", "left_semi") for x in places)
    told = candidate_links(again, p, p.sparse)
    dense = told.where("dense AND a = b").select(F.col("a").alias("k")).distinct()
    pairs = told.where("NOT dense").select("a", "b").distinct()
    pairs = pairs.join(dense.select(F.col("k").alias("a"), F.lit(True).alias("x")), "a", "left").join(dense.select(F.col("k").alias("b"), F.lit(True).alias("y")), "b", "left")
    pairs = cut(pairs.select("a", "b", (F.col("x").isNotNull() | F.col("y").isNotNull()).alias("dense")), "jaccard-pairs", slim=True)
    of_dense = components(told.where("dense").select("a", "b").unionByName(pairs.where("dense").select("a", "b")))
    of_dense = large.drop("c").join(of_dense.select(F.col("node").alias("k"), F.col("label").alias("c")), "k").join(dense.withColumn("dense", F.lit(True)), "k", "left")
    of_dense = of_dense.withColumns({"dense": F.coalesce("dense", F.lit(False)), "final": F.lit(False), "c": F.xxhash64(F.lit("dense"), "c")})
    # dealt() reads its classes twice
    both = cut(rest.unionByName(of_dense), "jaccard-dealt", slim=True)
    return dealt(both, p).unionByName(starred(pairs.where("NOT dense").select("a", "b"), large.select("k", "size"), p))


#: Ids of documents with candidates up to which they are broadcast, 16 MB; beyond, a shuffle joins them to the texts.
MOST_KEYS = 1_000_000


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Join = Join(), figures: dict | None = None) -> DataFrame:  # noqa: B008
    """One row per input row: doc_id, class_id, n_links, set_size.

    n_links: how many other documents have a similarity of at least ``least`` (documents
    with the same set included). class_id: the smallest id of the documents connected by
    such links. A text of fewer words than a shingle is one shingle. Null and empty texts,
    and texts without words, have no links and are their own class. Null ids are allowed
    (smallest ids are taken over what is not null); repeated rows are copies of each
    other. Other columns of ``docs`` are not read; an empty table gives no rows. figures
    (if given) gets how many pairs were compared with whole sets, and copies of sets in cells.
    """
    p = params
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared_dir(docs.sparkSession)
    flat = cut(sketches(rows, p.words), "jaccard-sketches")
    classes = flat.where("d IS NOT NULL").groupBy("d").agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("k", F.xxhash64("d")), "jaccard-classes", slim=True)
    places = candidate_places(classes.select("k", "sig"), p)
    linked = components(candidate_links(places, p))
    linked = cut(linked.join(classes, linked["node"] == classes["k"]).select(F.col("label").alias("c"), "k", "d", "sig", "weight", "size", "first"), "jaccard-groups", slim=True)

    cells = cut(placed(linked.select("c", "k", "d", "size"), places, p).join(linked.select("k", "d", "sig", "weight"), "k").drop("k"), "jaccard-cells", slim=True)

    # whole sets, of one row of each class that has a candidate
    lowest = F.lit(-(2**63))
    wanted = cut(linked.select(F.coalesce("first", lowest).alias("key")).distinct(), "jaccard-keys", slim=True)
    if wanted.count() <= MOST_KEYS:
        wanted = F.broadcast(wanted)
    texts = rows.withColumn("key", F.coalesce("doc_id", lowest)).join(wanted, "key", "left_semi").select("text")
    met = cut(exact_links(with_sets(texts, p.words).join(cells, "d").select(*PLACE, "d", "sig", "weight", "found"), p), "jaccard-links")
    if figures is not None:
        figures |= met.agg((F.coalesce(F.sum("compared"), F.lit(0)) / 2).cast("long").alias("pairs"), F.count(F.lit(1)).alias("copies")).first().asDict()

    counted = met.groupBy("d").agg(F.sum("links").alias("links"))
    # within one cell the roots are final; forests of several cells have to be joined
    in_parts = met.where("NOT alone")
    label = met.where("alone").select(F.col("d").alias("node"), F.col("root").alias("label"))
    label = label.unionByName(components(in_parts.select(F.col("d").alias("a"), F.col("root").alias("b"))))
    of_class = classes.select("d", "weight", "first").join(counted, "d", "left").join(label.withColumnRenamed("node", "d"), "d", "left")
    of_class = of_class.select("d", "first", F.coalesce("label", "d").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least_id = of_class.groupBy("label").agg(F.min("first").alias("class_id"))
    of_class = of_class.join(least_id, "label").select("d", "class_id", "n_links")
    return flat.select("doc_id", "d", "size").join(of_class, "d", "left").select("doc_id", F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("size").alias("set_size"))


def with_sets(texts: DataFrame, words: int) -> DataFrame:
    """d, found (the set's hashes, little-endian) of each text."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordHash()
        for batch in batches:
            for at in range(0, len(batch), 256):
                each = [shingles(text, words, table) for text in batch["text"].iloc[at : at + 256]]
                each = [x for x in each if len(x)]
                yield pd.DataFrame({"d": [xxhash.xxh3_128_digest(x.tobytes()) for x in each], "found": [x.astype("<u8").tobytes() for x in each]})

    return texts.mapInPandas(rows, "d binary, found binary")


def one_of_each(docs: DataFrame, params: Join = Join()) -> DataFrame:  # noqa: B008
    """docs with one document of each class of linked documents, the one with the smallest id; all columns stay.

    Decisions are about ids: rows without an id stay, and so do repeated rows of an id
    that is kept (exact dedup, which comes first, leaves one of them).
    """
    joined = join(docs, params=params)
    key, lowest = private(docs.columns, "key")["key"], F.lit(-(2**63))
    keep = joined.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.coalesce("doc_id", lowest).alias(key)).distinct()
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), lowest)).join(keep, key, "left_semi").select(*docs.columns)
