"""Validation ladders: ordered rules of which the first that fails names the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..functions import binary, paths
from ..functions.text import extension

SUPPORTED = (".docx", ".pptx", ".pdf")
#: What an Office archive must hold.
REQUIRED = {"docx": ("[Content_Types].xml", "word/document.xml"), "pptx": ("[Content_Types].xml", "ppt/presentation.xml")}


def first_failure(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule whose condition holds; null if none does (a null condition does not hold)."""
    return F.coalesce(*[F.when(failed, F.lit(code)) for failed, code in rules])


def source_type(filename: Column) -> Column:
    ext = extension(filename)
    return F.when(ext.isin(*SUPPORTED), F.substring(ext, 2, 10))


def declared(filename: Column, size: Column, limits: Limits = Limits()) -> Column:  # noqa: B008
    """What can be told before any content is read. An empty object could not have been retrieved."""
    return first_failure(
        (~F.coalesce(extension(filename), F.lit("")).isin(*SUPPORTED), "UNSUPPORTED_FILE_TYPE"),
        (size > limits.max_source_bytes, "FILE_TOO_LARGE"),
        (size <= 0, "DOWNLOAD_FAILED"),
    )


def content(kind: Column, head: Column) -> Column:
    """What the first bytes tell: not a PDF, an encrypted Office file (a compound file), or no archive at all."""
    office = kind.isin("docx", "pptx")
    return first_failure(
        ((kind == "pdf") & ~binary.begins(head, binary.PDF), "INVALID_FILE_FORMAT"),
        (office & binary.begins(head, binary.CFB), "PASSWORD_PROTECTED"),
        (office & ~binary.begins(head, binary.ZIP), "INVALID_FILE_FORMAT"),
    )


def unsafe_member(name: Column) -> Column:
    """An absolute path, a drive letter or a step upwards; folders do not count."""
    plain = F.replace(name, F.lit("\\"), F.lit("/"))
    climbs = F.array_contains(F.split(plain, "/"), "..")
    return ~plain.endswith("/") & (plain.startswith("/") | plain.rlike(r"\A[A-Za-z]:") | climbs)


def ratio(expanded: Column, compressed: Column) -> Column:
    return F.when(compressed > 0, expanded / compressed).otherwise(F.lit(0.0))


def archive(members: Column, expanded: Column, compressed: Column, unsafe: Column, limits: Limits = Limits()) -> Column:  # noqa: B008
    return first_failure(
        (members > limits.max_members, "OFFICE_ARCHIVE_UNSAFE"),
        (unsafe, "OFFICE_ARCHIVE_UNSAFE"),
        (expanded > limits.max_expanded_bytes, "DOCUMENT_EXPANDS_TOO_LARGE"),
        ((expanded > limits.ratio_checked_from) & (ratio(expanded, compressed) > limits.max_ratio), "OFFICE_ARCHIVE_UNSAFE"),
    )


def missing_members(kind: Column, names: Column) -> Column:
    """The required members that an archive lacks."""
    required = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, v))) for k, v in REQUIRED.items()], F.array().cast("array<string>"))
    return F.array_except(required, names)


def archive_stats(members: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, members, expanded, compressed, ratio, unsafe from rows doc, name, file_size, compress_size."""
    out = members.groupBy(doc).agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("file_size").alias("expanded"),
        F.sum("compress_size").alias("compressed"),
        F.bool_or(unsafe_member(F.col("name"))).alias("unsafe"),
    )
    return out.withColumn("ratio", ratio(F.col("expanded"), F.col("compressed")))


def prepared(job: Column, source: Column, result: Column, media: Column, exists: Column, size: Column, limits: Limits = Limits()) -> Column:  # noqa: B008
    """What a prepared job must satisfy before its token is issued."""
    ending = F.when(media, ".zip").otherwise(".md")
    return first_failure(
        (job.isNull() | source.isNull() | result.isNull(), "JOB_TOKEN_INVALID"),
        (~paths.belongs_to(source, job) | ~paths.belongs_to(result, job), "JOB_TOKEN_INVALID"),
        (~source.contains("/source/") | ~result.contains("/result/"), "JOB_TOKEN_INVALID"),
        (~result.endswith(ending), "JOB_TOKEN_INVALID"),
        (~extension(source).isin(*SUPPORTED), "UNSUPPORTED_FILE_TYPE"),
        (~F.coalesce(exists, F.lit(False)), "BLOB_NOT_FOUND"),
        (size <= 0, "INVALID_FILE_FORMAT"),
        (size > limits.max_source_bytes, "FILE_TOO_LARGE"),
    )


def uploadable(path: Column) -> Column:
    """struct<error_code, content_type, max_bytes, minutes>: what an upload to a key may be; null constraints where it may not."""
    code = first_failure(
        (~paths.belongs_to(path, F.regexp_extract(path, r"\Ajobs/\d{4}-\d{2}-\d{2}/([^/]+)/", 1)) | ~path.contains("/source/"), "JOB_TOKEN_INVALID"),
        (~extension(path).isin(*SUPPORTED), "UNSUPPORTED_FILE_TYPE"),
    )
    fine = lambda c: F.when(code.isNull(), c)
    return F.struct(code.alias("error_code"), fine(paths.mime(extension(path))).alias("content_type"), fine(F.lit(Limits().max_source_bytes)).alias("max_bytes"), fine(F.lit(paths.URL_TTL_MINUTES["put"])).alias("minutes"))


def downloadable(token_code: Column, signed_path: Column, asked_path: Column, exists: Column) -> Column:
    """The error of a request for a result: its token (verified without skew), its path, the object's existence."""
    return F.coalesce(
        token_code,
        first_failure(
            (~F.coalesce(signed_path == asked_path, F.lit(False)), "JOB_TOKEN_INVALID"),
            (~F.coalesce(exists, F.lit(False)), "BLOB_NOT_FOUND"),
        ),
    )
