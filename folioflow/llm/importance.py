"""Importance resampling towards a target distribution over hashed n-grams.

Each worker keeps a dictionary of words: an integer per distinct word. A text is a run of
these integers, an n-gram a tuple of them; of a stretch of documents the distinct tuples
are found by sorting integers, each distinct one is written out and hashed once, and its bucket goes back to all its
places by the inverse of that sort. So no string is hashed, compared or moved more than once a stretch, and no
word, however frequent, is a key of a shuffle.

Each document's counts per bucket are written once as a slim table; the totals of all
buckets, the weights and the draw come from it. The draw is a distributed sort: ranks are
positions within sorted partitions plus the sizes of the partitions before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A-Z in lower case; what separates words (all other ASCII but digits and letters) becomes a space; bytes above 127 belong to words.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
#: Words a worker's dictionary holds before it starts anew.
WORDS = 2_000_000
#: Words of documents that are counted at a time (a longer document is counted alone).
STRETCH = 1_000_000


@dataclass(frozen=True)
class Resampling:
    #: n-grams of 1 to ``longest`` words
    longest: int = 1
    buckets: int = 10_000
    #: of 100 documents with at least ``least_words`` words as many are drawn, rounded down over all
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


class Dictionary(dict):
    """Word -> id, in the order of their first use."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.words)
        self.words.append(word)
        return i


class Counter:
    """Counts of buckets per document, for stretches of documents."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.words, self.bucket = Dictionary(), np.empty(0, dtype=np.int64)

    def hashed(self, distinct: list[bytes]) -> np.ndarray:
        return np.fromiter((zlib.crc32(b) % self.buckets for b in distinct), np.int64, len(distinct))

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document number, bucket and count, by document and bucket, of documents given as words."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if len(self.words.words) > WORDS:
            self.words, self.bucket = Dictionary(), self.bucket[:0]
        ids = np.fromiter((i for t in texts for i in map(self.words.__getitem__, t)), np.int64, int(sizes.sum()))
        self.bucket = np.concatenate([self.bucket, self.hashed(self.words.words[len(self.bucket) :])])
        doc = np.repeat(np.arange(len(texts)), sizes)
        keys = [doc * self.buckets + self.bucket[ids]]
        tuples, starts = ids, np.arange(len(ids))  # the n-gram that begins at each start, as a number; equal numbers, equal n-grams
        for n in range(2, self.longest + 1):
            inside = starts + n - 1 < len(ids)
            inside[inside] = doc[starts[inside]] == doc[starts[inside] + n - 1]
            starts, tuples = starts[inside], tuples[inside]
            _, first, tuples = np.unique(tuples * len(self.words.words) + ids[starts + n - 1], return_index=True, return_inverse=True)
            words = self.words.words
            distinct = self.hashed([b" ".join([words[i] for i in ids[s : s + n]]) for s in starts[first]])
            keys.append(doc[starts] * self.buckets + distinct[tuples])
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        return keys // self.buckets, keys % self.buckets, counts


def features(docs: DataFrame, settings: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and the document's counts per bucket: two binaries, buckets as unsigned 32-bit integers and counts as bytes.

    A count over 255 takes several entries. Null texts have no words.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    longest, buckets = settings.longest, settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(longest, buckets)

        def out(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
            doc, bucket, n = count(texts)
            times = -(-n // 255)  # entries that a count takes
            places = np.repeat(np.arange(len(n)), times)
            last = np.cumsum(times) - 1
            value = np.full(len(places), 255, dtype=np.uint8)
            value[last] = (n - 255 * (times - 1)).astype(np.uint8)
            doc, bucket = doc[places], bucket[places].astype("<u4")
            ends = np.searchsorted(doc, np.arange(len(texts) + 1), "left")
            words = np.array([len(t) for t in texts], dtype=np.int64)
            grams = sum((np.maximum(words - k, 0) for k in range(1, longest)), start=words)
            binary = [pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()) for x in (bucket, value)]
            return pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(grams, pa.int64()), *binary], ["doc_id", "n_words", "n_features", "buckets", "counts"])

        for batch in batches:
            begin, size, texts = 0, 0, []
            column = batch.column("text")
            for i in range(batch.num_rows):
                text = column[i].as_py()
                texts.append(text.encode().translate(TABLE).split() if text else [])
                size += len(texts[-1])
                if size >= STRETCH or i + 1 == batch.num_rows:
                    yield out(batch.column("doc_id").slice(begin, len(texts)), texts)
                    begin, size, texts = i + 1, 0, []

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets binary, counts binary")


def totals(counted: DataFrame, settings: Resampling) -> DataFrame:
    """bucket, n: features of all documents; a task sends one row a bucket at most."""
    size = settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, dtype=np.int64)
        for batch in batches:
            buckets, counts, _ = entries(batch)
            found += np.bincount(buckets, weights=counts, minlength=size).astype(np.int64)
        some = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["bucket", "n"])

    return counted.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' buckets and counts, and where each row's begin, with their end."""
    buckets, counts = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=t) for c, t in (("buckets", "<u4"), ("counts", "u1")))
    sizes = pc.binary_length(batch.column("counts")).to_numpy(zero_copy_only=False)
    return buckets, counts, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def gains(raw: DataFrame, target: DataFrame, settings: Resampling) -> np.ndarray:
    """Each bucket's gain floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) from totals; settings.buckets numbers."""
    spark = raw.sparkSession
    every = spark.range(settings.buckets).withColumnRenamed("id", "bucket")
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    sums = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    all_raw, all_target = float(sums["S"] + settings.buckets), float(sums["T"] + settings.buckets)
    ratio = (F.col("t") + 1).cast("double") * F.lit(all_raw) / ((F.col("s") + 1).cast("double") * F.lit(all_target))
    found = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).collect()  # settings.buckets rows
    out = np.zeros(settings.buckets, dtype=np.int64)
    out[[r["bucket"] for r in found]] = [r["gain"] for r in found]
    return out


def weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of the gains of a document's features."""
    kind = counted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts, ends = entries(batch)
            sums = np.concatenate([[0], np.cumsum(gain[buckets] * counts)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return counted.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h the first 8 hex digits of sha256 of seed:id; a null id is an empty text there."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, settings: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank for every document; rank is null for those not drawn.

    Null and empty texts have no features, weight 0 and are never drawn. Equal scores go by
    smaller id (null last), then by more features; rows that agree in all of these are alike. Repeated rows are drawn each for
    itself. An empty ``docs`` gives an empty table; with an empty ``target`` only the smoothing counts. Other columns are not read.
    """
    counted = cut(features(docs, settings, id_col, text_col), "importance-features")
    wanted = target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text"))
    gain = gains(totals(counted, settings), totals(features(wanted, settings), settings), settings)
    scored = cut(weighed(counted, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), settings.seed)).withColumn("fit", F.col("n_words") >= settings.least_words), "importance-scores")
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc(), F.col("tie")]
    dealt = scored.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.select("doc_id", "n_features", "weight", "score", "fit", F.monotonically_increasing_id().alias("at")), "importance-order")
    return ranked(dealt, settings.percent)


def ranked(dealt: DataFrame, percent: int) -> DataFrame:
    """Ranks from places within sorted partitions: the number of a partition is in the upper bits of ``at``."""
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fit").cast("long")).alias("fit")).orderBy("part").collect()  # a row for each partition
    drawn = sum(r["fit"] for r in sizes) * percent // 100
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], before))
        before += r["n"]
    known = F.broadcast(dealt.sparkSession.createDataFrame(offsets, "part long, before long"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = dealt.withColumn("part", part).join(known, "part")
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (place <= drawn), place).alias("rank"))
