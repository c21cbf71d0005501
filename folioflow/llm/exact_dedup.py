"""Exact dedup with a heavy-hitter split.

Every text is normalised (white space deleted) and digested on the JVM. Misra-Gries
summaries, one per partition, name the digests that may hold more than ``heavy_share``
of all rows; their true counts and winners are then computed by one pre-aggregated
group-by. At most ``1 / heavy_share`` digests pass, so that table has a proven bound and
is broadcast: rows of frequent digests are decided map-side and never shuffled. All other
digests take the ordinary shuffle, where no group exceeds ``heavy_share`` of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, private, text_or_empty

#: Deleted before comparison: space and U+0009 to U+000D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
HEAVY_SHARE = 1 / 2000


def misra_gries(batches: Iterator[pd.DataFrame], counters: int) -> Iterator[pd.DataFrame]:
    """The Misra-Gries summary of one partition: at most ``counters`` digests; whatever holds over 1/(counters+1) of the rows is among them.

    Batches are folded in as mergeable summaries: add the counts, then subtract the
    (counters+1)-th largest from all and keep what is above zero.
    """
    kept = pd.Series(dtype="int64")
    for batch in batches:
        kept = kept.add(batch["digest"].value_counts(), fill_value=0)
        if len(kept) > counters:
            kept = kept - kept.nlargest(counters + 1).iloc[-1]
            kept = kept[kept > 0]
    if len(kept):
        yield pd.DataFrame({"digest": kept.index, "seen": kept.to_numpy("int64")})


def heavy_winners(slim: DataFrame, heavy_share: float) -> DataFrame:
    """digest, group_size, win of the digests that hold over heavy_share of all rows: under 1/heavy_share rows.

    With 2/heavy_share counters a partition's summary misses at most heavy_share/2 of its
    rows for a digest, so the sums over partitions are over half the threshold for every
    digest sought, and for under 2/heavy_share digests in all.
    """
    counters, total = int(2 / heavy_share), slim.count()
    candidates = (
        slim.select("digest")
        .mapInPandas(lambda batches: misra_gries(batches, counters), "digest binary, seen long")
        .groupBy("digest")
        .agg(F.sum("seen").alias("seen"))
        .where(F.col("seen") >= total * heavy_share / 2)
    )
    # under 2/heavy_share rows of 32 bytes
    exact = slim.join(F.broadcast(candidates.select("digest")), "digest", "left_semi")
    exact = exact.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min("rank").alias("win"))
    return exact.where(F.col("group_size") > total * heavy_share)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row per input row: doc_id, row_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; all empty texts form one group. In a group the row with
    the most code points in the original text stays, then the smallest id (a null id
    comes last), then, for repeated rows, the earliest row; exactly one row is kept.
    No rows give no rows. Other columns of ``docs`` are not read.
    """
    text = text_or_empty(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, WHITE_SPACE, ""), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("n"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    # the row that wins has the smallest rank
    rank = F.struct((-F.col("n")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row_id").alias("row"))
    slim = cut(slim, "exact-dedup").withColumn("rank", rank)
    heavy = cut(heavy_winners(slim, heavy_share), "exact-dedup-heavy")
    # under 1/heavy_share rows of about 100 bytes
    of_heavy = slim.join(F.broadcast(heavy), "digest").select("doc_id", "row_id", "digest", "group_size", "win")
    group = Window.partitionBy("digest")
    of_light = slim.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "doc_id", "row_id", "digest", F.count(F.lit(1)).over(group).alias("group_size"), F.min("rank").over(group).alias("win")
    )
    return of_heavy.unionByName(of_light).select(
        "doc_id",
        "row_id",
        F.col("win.id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("win.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


#: Ids that drop_exact_copies broadcasts at most (8 bytes each); more are joined by a shuffle.
MOST_IDS = 4_000_000


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = HEAVY_SHARE, most_ids: int = MOST_IDS) -> DataFrame:
    """docs with one row of each group of equal texts; all columns stay, whatever their names.

    Ids need not be unique or present. The decision returns to the rows by their ids: an
    id of which all rows stay or all rows go needs nothing else. Rows of other ids, which have
    one and the same id but do not share their fate, and rows without an id are decided by
    their texts: those that belong to no row that stays go, and of repeated rows of one that
    stays the first by text stays. Texts of other rows are neither digested again nor moved, unless more
    than ``most_ids`` ids lose rows.
    """
    own = private(docs.columns, "id", "fate", "digest", "n", "place")
    key, fate, digest, n, place = own.values()
    rows = cut(exact_groups(docs, id_col, text_col, heavy_share).select("doc_id", "kept", F.unhex("text_sha256").alias("digest")), "exact-dedup-fates")
    per = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("kept"), 1)).alias("stay"))
    lost = cut(per.where("stay < rows").select(F.col("doc_id").alias(key), F.when(F.col("stay") > 0, "mixed").otherwise("gone").alias(fate)), "exact-dedup-lost", slim=True)
    if lost.count() <= most_ids:  # a table of proven size
        lost = F.broadcast(lost)
    marked = docs.withColumn(key, F.col(id_col)).join(lost, key, "left")
    marked = marked.withColumn(fate, F.when(F.col(key).isNull(), "mixed").otherwise(F.coalesce(fate, F.lit("stays"))))
    stays = marked.where(F.col(fate) == "stays").select(*docs.columns)
    if rows.where("doc_id IS NULL").isEmpty() and per.where("stay BETWEEN 1 AND rows - 1").isEmpty():
        return stays
    text = text_or_empty(text_col)
    mixed = marked.where(F.col(fate) == "mixed").withColumn(digest, F.unhex(F.sha2(F.translate(text, WHITE_SPACE, ""), 256))).withColumn(n, F.char_length(text))
    kept = rows.where("kept").select(F.col("doc_id").alias(key), F.col("digest").alias(digest))
    there = mixed[key].eqNullSafe(kept[key]) & (mixed[digest] == kept[digest])
    order = Window.partitionBy(key, digest).orderBy(F.col(n).desc(), text)
    first = mixed.join(kept, there, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return stays.unionByName(first.select(*docs.columns))
