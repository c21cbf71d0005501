"""Extractors as table functions, for SQL:

    SELECT f.name, i.* FROM files f, LATERAL document_items(f.content, f.extension) i
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..config import Limits
from .extract import isolated

PARAGRAPHS = ArrayType(StructType().add("level", IntegerType()).add("text", StringType()))
COLUMNS = {"seq": IntegerType(), "part_no": IntegerType(), "kind": StringType(), "text": StringType(), "paragraphs": PARAGRAPHS, "rows": ArrayType(ArrayType(StringType())), "alt": StringType(), "extension": StringType(), "digest": StringType(), "error_code": StringType()}
KINDS = ("docx", "pptx", "pdf")


class DocumentItems:
    """The items of a document in the order in which its extractor meets them: headings of parts, frames, tables, images, warnings, finished blocks.

    document_items(content, type [, media]): type is docx, pptx or pdf, with or without a dot. With media = true (a
    constant) rows have the column content as well, and pictures are decoded. A document that cannot be read, a null
    one, or one of another type is one row with its error_code.
    """

    @staticmethod
    def analyze(content: AnalyzeArgument, type: AnalyzeArgument, media: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(content.dataType, BinaryType):
            raise ValueError("the first argument must be the document's bytes")
        if not isinstance(type.dataType, StringType):
            raise ValueError("the second argument must be the document's type")
        if media is not None and (not media.isConstantExpression or media.value is None):
            raise ValueError("the third argument must be a constant, true or false")
        schema = StructType()
        for name, kind in COLUMNS.items():
            schema.add(name, kind)
        return AnalyzeResult(schema.add("content", BinaryType()) if media is not None and media.value else schema)

    def eval(self, content: bytes | None, type: str | None, media: bool = False) -> Iterator[tuple]:
        kind = (type or "").lstrip(".").lower()
        if kind not in KINDS or content is None:
            yield (0, None, None, None, None, None, None, None, None, "UNSUPPORTED_FILE_TYPE" if content is not None else "DOWNLOAD_FAILED", *([None] * media))
            return
        got = isolated(kind, bytes(content), Limits(include_media=media))
        if got.error_code:
            yield (0, None, None, None, None, None, None, None, None, got.error_code, *([None] * media))
        for seq, item in enumerate(got.items):
            row = item.row()
            paragraphs = None if row["paragraphs"] is None else [(p["level"], p["text"]) for p in row["paragraphs"]]
            yield (seq, row["part_no"], row["kind"], row["text"], paragraphs, row["rows"], row["alt"], row["ext"], row["digest"], None, *([row["content"]] * media))


def register(spark: SparkSession) -> None:
    """Make document_items known to the session's SQL."""
    spark.udtf.register("document_items", udtf(DocumentItems))
