"""Results of conversions: quotas, the shape that is delivered, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..sources.budget import TableBudget
from .ladder import first_failure
from .ordered import folded

#: Every member has this time, so that the same files give the same bytes.
EPOCH = (1980, 1, 1, 0, 0, 0)
FILES = "array<struct<path:string,content:binary>>"


def shape(include_media: Column, media_count: Column) -> Column:
    """zip where media were asked for and found; else md."""
    return F.when(include_media & (media_count > 0), "zip").otherwise("md")


def content_type(kind: Column) -> Column:
    return F.when(kind == "zip", "application/zip").otherwise("text/markdown; charset=utf-8")


def quota(markdown_bytes: Column, media_bytes: Column, result_bytes: Column, limits: Limits = Limits()) -> Column:  # noqa: B008
    """The error of an output tree, and then of a result, that is too large."""
    return first_failure(
        (markdown_bytes + media_bytes > limits.max_output_bytes, "DOCUMENT_EXPANDS_TOO_LARGE"),
        (result_bytes > limits.max_result_bytes, "RESULT_TOO_LARGE"),
    )


def member_path(stem: Column, path: Column) -> Column:
    return F.concat(stem, F.lit("_markdown/"), path)


def archive(files: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of files in the order of their paths, deflated at level 6."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for path, content in sorted(files):
            info = zipfile.ZipInfo(path, EPOCH)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def packaged(trees: DataFrame, doc: str = "doc_id", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """doc, content, error_code from one row per document: doc, stem, files (FILES, paths relative to the archive's root folder).

    A document without files is CONVERSION_FAILED; an archive over the limit is RESULT_TOO_LARGE and has no content.
    """
    return files_of(trees.select(doc, "stem", F.lit("zip").alias("shape"), "files"), doc, limits).drop("name")


def files_of(trees: DataFrame, doc: str, limits: Limits) -> DataFrame:
    """doc, name, content, error_code from doc, stem, shape, files: an archive of all files, or the first file as it is."""
    most = limits.max_result_bytes
    kind = trees.schema[doc].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                stem, shape, files = (batch.column(c)[i].as_py() for c in ("stem", "shape", "files"))
                name, made, code = f"{stem}_markdown.zip" if shape == "zip" else f"{stem}.md", None, None
                if not files:
                    code = "CONVERSION_FAILED"
                else:
                    made = archive([(f"{stem}_markdown/{f['path']}", f["content"]) for f in files]) if shape == "zip" else files[0]["content"]
                    if len(made) > most:
                        made, code = None, "RESULT_TOO_LARGE"
                yield pa.RecordBatch.from_arrays([batch.column(doc).slice(i, 1), pa.array([name]), pa.array([made], pa.binary()), pa.array([code], pa.string())], [doc, "name", "content", "error_code"])

    return trees.select(doc, "stem", "shape", "files").mapInArrow(rows, f"{doc} {kind}, name string, content binary, error_code string")


def table_budget(pages: DataFrame, doc: str, page: str, limits: Limits = Limits(), seconds: str = "seconds", count: str = "pages") -> DataFrame:  # noqa: B008
    """pages with ``tables``, what TableBudget makes of each page's tables from the seconds they took; count is the document's number of pages."""

    def step(budget: list[TableBudget], spent: float | None, n: int) -> tuple[str]:
        if not budget:
            budget.append(TableBudget(limits, n))
        return (budget[0].judge(spent),)

    return folded(pages, doc, [page], [seconds, count], {"tables": "string"}, list, step)
