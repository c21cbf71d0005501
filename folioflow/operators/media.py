"""Media of documents: content-addressed, named by first occurrence, within a budget.

Rows carry digests, never bytes, through every shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import folded


def first_occurrences(refs: DataFrame, doc: str = "doc_id", digest: str = "digest", seq: str = "seq") -> DataFrame:
    """The first row of each digest in a document."""
    w = Window.partitionBy(doc, digest).orderBy(seq)
    return refs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def numbered(prefix: str, part: Column, index: Column, extension: Column) -> Column:
    """slide-003-image-007.png"""
    return F.concat(F.format_string(f"{prefix}-%03d-image-%03d", part.cast("int"), index.cast("int")), extension)


def named(refs: DataFrame, doc: str = "doc_id", per_part: bool = False, prefix: str = "slide") -> DataFrame:
    """refs (doc, digest, seq, part_no, position, extension) with the name of each digest's file.

    A name has the part of the first occurrence and a number: that occurrence's position
    in its part (per_part), or how many distinct files the document had so far, plus one.
    """
    firsts = first_occurrences(refs, doc)
    number = F.col("position") if per_part else F.row_number().over(Window.partitionBy(doc).orderBy("seq"))
    names = firsts.select(doc, "digest", numbered(prefix, F.col("part_no"), number, F.col("extension")).alias("name"))
    return refs.join(names, [doc, "digest"])


def without_collisions(files: DataFrame, doc: str, preferred: str, order: str) -> DataFrame:
    """files with ``name``: the preferred name, or the first of stem-2.ext, stem-3.ext ... that no file before it has in its document."""

    def step(used: dict[str, int], wanted: str | None) -> tuple[str | None]:
        if wanted is None:
            return (None,)
        name = wanted
        if name in used:
            dot, n = wanted.rfind("."), used[wanted]
            while name in used:
                n += 1
                name = f"{wanted[: max(dot, 0)]}-{n}.{wanted[dot + 1 :]}"
            used[wanted] = n  # all numbers up to this one are taken
        used.setdefault(name, 1)
        return (name,)

    return folded(files, doc, [order], [preferred], {"name": "string"}, dict, step)


def distinct_count(refs: DataFrame, doc: str = "doc_id", digest: str = "digest", seq: str = "seq") -> DataFrame:
    """doc, refs, media_count (distinct digests), first_seq; counted by digest first, so no document is one task's work."""
    files = refs.groupBy(doc, digest).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("seq"))
    return files.groupBy(doc).agg(F.sum("n").alias("refs"), F.count(F.lit(1)).alias("media_count"), F.min("seq").alias("first_seq"))


def by_reference(files: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """kind (referenced or unreferenced) and key of each file. The documents' contract is that nothing is unreferenced."""
    used = references.select(key).distinct().withColumn("__used", F.lit(True))  # a key once, so that no task sorts its references
    return files.join(used, key, "left").select(F.when(F.col("__used"), "referenced").otherwise("unreferenced").alias("kind"), key)


def within_budget(firsts: DataFrame, limit: int, doc: str = "doc_id", size: str = "n_bytes", seq: str = "seq") -> DataFrame:
    """doc, media_count, media_bytes, error_code: DOCUMENT_EXPANDS_TOO_LARGE where the distinct files exceed the limit, with what had been written by then."""
    total = F.sum(size).over(Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = firsts.withColumn("total", total).withColumn("fits", F.col("total") <= limit)
    return fits.groupBy(doc).agg(
        F.count(F.when(F.col("fits"), 1)).alias("media_count"),
        F.coalesce(F.max(F.when(F.col("fits"), F.col("total"))), F.lit(0)).alias("media_bytes"),
        F.when(F.bool_or(~F.col("fits")), "DOCUMENT_EXPANDS_TOO_LARGE").alias("error_code"),
    )
