"""The corpus pipeline: documents without toxic ones and copies, without secrets, packed into windows.

Every stage reads what its predecessor wrote. All but the last return the columns of
documents; the last returns the pieces of the packed windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import exact_dedup, jaccard_join, packing, secret_scan, toxicity
from folioflow.llm.common import delete, mark, shared_dir, sweep, table
from folioflow.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity network does not reject."""
    settings = toxicity.Settings()
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), settings), settings.threshold)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents connected by a Jaccard similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 2048 tokens."""
    pieces = packing.pack(docs, VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: SQL can express neither the network nor the window packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again.

    What a stage wrote on its way, and its predecessor's rows, are deleted once its own rows
    are written. The last stage's input stays, as the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        begun = mark()
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = f"{root}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        sweep(spark, begun)
        if before:
            delete(spark, before)
        before = path
    return docs
