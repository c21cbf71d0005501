"""Document fingerprints by a threshold-scaled sketch. DataFrame functions only.

A shingle is five words in a row (fewer where the text has no more); its hash combines
the words' hashes. A fixed share of the range of hashes is retained: every shingle whose
hash lies below the threshold, whatever the length of the text, and of short texts the FLOOR least hashes. Sketches
of long texts therefore grow with their texts, those of short texts hold all or FLOOR of their shingles, and the
sketch of a union is made of the sketches alone: what is below the threshold in either, and the least of both.

Of two sketches each is complete up to some hash, its reach: the threshold or its last hash, or all hashes if
the text has fewer shingles than FLOOR. Up to the lesser reach both show all that their texts have, so
the shares there estimate likeness, and containment also between very unequal texts. Everything is computed from two
sketches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
SHARE = 1 / 64
FLOOR = 32
#: Hashes are numbers of so many bits.
BITS = 32
LOWEST = -(2**63)
#: Rows a bucket of neighbouring ids holds, and the most buckets (the bounds are one array of longs on the driver).
BUCKET_ROWS, MOST_BUCKETS = 5000, 1 << 16


def below(share: float) -> int:
    """The hash from which on hashes are not retained for their size."""
    return int(2**BITS * share)


def bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def retained(hashes: Column, share: float = SHARE, floor: int = FLOOR) -> Column:
    """Of ascending distinct hashes those below the threshold, and of the others the least until there are ``floor``."""
    return bound(hashes, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(F.filter(h, lambda x: x < below(share))), F.least(F.size(h), F.lit(floor)))))


def sketch(text: Column, words: int = WORDS, share: float = SHARE, floor: int = FLOOR) -> Column:
    """The retained hashes of a text, ascending and distinct: array<bigint>. A text without words has none."""
    hashes = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    short = lambda x: F.shiftrightunsigned(x, 64 - BITS)

    def shingles(h: Column) -> Column:
        last = F.greatest(F.size(h) - words, F.lit(0))
        whole = F.transform(F.sequence(F.lit(1), last + 1), lambda i: short(F.xxhash64(*[F.element_at(h, i + j) for j in range(words)])))
        return F.when(F.size(h) >= words, whole).when(F.size(h) > 0, F.array(short(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " "))))).otherwise(F.array().cast("array<bigint>"))

    distinct = lambda s: F.array_sort(F.array_distinct(s))

    def least(s: Column) -> Column:
        """Few hashes that are enough nearly always, so that only they are sorted; all where they are not."""
        enough = F.greatest(F.lit(float(below(share))), F.lit(3.0 * floor * 2**BITS) / F.greatest(F.size(s), F.lit(1)))
        few = distinct(F.filter(s, lambda x: x < enough))
        return bound(few, lambda few: F.when(F.size(few) >= F.least(F.size(s), F.lit(floor)), few).otherwise(distinct(s)))

    return retained(bound(bound(hashes, shingles), least), share, floor)


def reach(a: Column, share: float = SHARE, floor: int = FLOOR) -> Column:
    """The hash up to which a sketch shows all that its text has."""
    return F.when(F.size(a) < floor, F.lit(2**BITS)).otherwise(F.greatest(F.lit(below(share) - 1), F.element_at(a, -1)))


def upto(a: Column, most: Column) -> Column:
    return F.size(F.filter(a, lambda x: x <= most))


def containment(a: Column, b: Column, share: float = SHARE, floor: int = FLOOR) -> Column:
    """The estimated share of a's shingles that b has; null where a shows none up to b's reach."""
    most = F.least(reach(a, share, floor), reach(b, share, floor))
    return bound(most, lambda most: bound(upto(a, most), lambda n: F.when(n > 0, upto(F.array_intersect(a, b), most) / n)))


def likeness(a: Column, b: Column, share: float = SHARE, floor: int = FLOOR) -> Column:
    """The estimated Jaccard similarity; exact where both texts have fewer than ``floor`` shingles. Two empty sketches are alike (1)."""
    most = F.least(reach(a, share, floor), reach(b, share, floor))

    def shares(most: Column) -> Column:
        return bound(upto(F.array_intersect(a, b), most), lambda both: both / F.greatest(upto(a, most) + upto(b, most) - both, F.lit(1)))

    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(bound(most, shares))


def written(a: Column) -> Column:
    """A sketch as text: its hashes as four bytes each, in base 64."""
    digits = F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")
    return F.translate(F.base64(F.unhex(digits)), "\r\n", "")


def merged(a: Column, b: Column, share: float = SHARE, floor: int = FLOOR) -> Column:
    """The sketch of both texts together."""
    return retained(F.array_sort(F.array_union(a, b)), share, floor)


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    at = F.array(*[F.lit(s) for s in steps])
    table = F.lit(bounds)
    return F.aggregate(at, F.lit(0), lambda acc, s: F.when((acc + s <= len(bounds)) & (F.get(table, acc + s - 1) <= key), acc + s).otherwise(acc))


def with_next(rows: DataFrame, columns: tuple[str, ...], made: dict[str, Column] | None = None) -> DataFrame:
    """rows (doc_id, text, ...) with the columns in made, and next_<column> of the row that follows by doc_id, then text; after the last row comes the first.

    Rows are dealt into buckets between quantiles of doc_id (null ids first), so no sort
    meets all rows. A bucket also gets a copy of the next bucket's first row. Beyond
    BUCKET_ROWS * MOST_BUCKETS rows buckets grow; their sorts and windows then spill.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    keys = rows.select(key.alias("k"))
    n = keys.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    bounds: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(keys.agg(F.percentile_approx("k", shares, 10 * buckets)).first()[0]))
    rows = rows.withColumn("__key", key).withColumn("__bucket", bucket_of(F.col("__key"), bounds))
    # one row for each bucket that has rows: at most MOST_BUCKETS
    firsts = rows.groupBy("__bucket").agg(F.min("__key").alias("__first"))
    ring = Window.partitionBy(F.lit(0)).orderBy("__bucket")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = firsts.select(F.col("__bucket").alias("__to"), F.coalesce(F.lead("__first").over(ring), F.first("__first").over(whole)).alias("__first"))
    guests = rows.join(F.broadcast(follows), F.col("__key") == F.col("__first")).withColumn("__bucket", F.col("__to")).withColumn("__guest", F.lit(1)).drop("__to", "__first")
    both = rows.withColumn("__guest", F.lit(0)).unionByName(guests).withColumns(made or {})  # once a row, and for the few copies
    order = Window.partitionBy("__bucket").orderBy("__guest", "__key", "text")
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("__guest = 0").drop("__key", "__bucket", "__guest")


def edited(text: Column, following: Column) -> Column:
    """text with its last half, rounded down, replaced by as many code points of the following text, or all it has."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: float = SHARE) -> DataFrame:
    """One row per input row: doc_id, text, sketch, next_text, next_sketch, edited, edited_sketch.

    Null texts count as empty; texts without words have an empty sketch. Null ids come before all others;
    rows with the same id are ordered by text; a lone row follows itself; an empty table
    gives no rows. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, ("text", "sketch"), {"sketch": sketch(F.col("text"), words, share)})
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return rows.withColumn("edited_sketch", sketch(F.col("edited"), words, share))
