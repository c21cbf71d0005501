"""Expressions over paths, URLs and object keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .text import slug

#: Minutes that objects of each class are kept, and media types.
RETENTION = {"source": 60, "result": 120, "status": 120}
MIME = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".pdf": "application/pdf",
    ".zip": "application/zip",
    ".md": "text/markdown; charset=utf-8",
}
URL_TTL_MINUTES = {"get": 20, "put": 20, "delete": 10}


def media_target(target: Column) -> Column:
    """The part of a link from its last folder ``media`` on; null where the link is to leave as it is."""
    segments = F.filter(F.split(F.replace(target, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    outside = target.rlike(r"\A(https?://|data:|#)")
    last = lambda segments, at: F.when(at > 0, F.array_join(F.slice(segments, F.size(segments) - at + 1, at), "/"))
    inside = let(segments, lambda segments: let(F.array_position(F.reverse(segments), "media").cast("int"), lambda at: last(segments, at)))
    return F.when(~outside, inside)


def portable_images(markdown: Column) -> Column:
    """Markdown whose image tags and image links with a media folder point to media/...; other tags and links stay.

    Tags come first, so that what they become is read as a link. Text is cut into pieces
    that each end with one tag (or link), and every piece is rewritten on its own.
    """
    tags = each_match(markdown, r"(?is)<img\b[^>]*?>", image_tag)
    return let(tags, lambda text: each_match(text, r"!\[[^\]]*\]\([^)]+\)", image_link))


def each_match(text: Column, pattern: str, rewrite) -> Column:
    """text with every match rewritten; what the last match leaves is kept."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0))

    def rewritten(parts: Column) -> Column:
        used = F.aggregate(parts, F.lit(0), lambda n, p: n + F.char_length(p))
        one = lambda p, match: F.concat(F.left(p, F.char_length(p) - F.char_length(match)), rewrite(match))
        done = F.transform(parts, lambda p: let(F.regexp_extract(p, rf"(?s)(?:{pattern})\z", 0), lambda match: one(p, match)))
        return F.concat(F.array_join(done, ""), F.substring(text, used + 1, F.char_length(text)))

    return let(parts, lambda parts: F.when(F.size(parts) > 0, rewritten(parts)).otherwise(text))


def image_tag(tag: Column) -> Column:
    target = media_target(F.regexp_extract(tag, r"""(?i)\bsrc\s*=\s*["']([^"']+)["']""", 1))
    alt = F.trim(F.regexp_extract(tag, r"""(?i)\balt\s*=\s*["']([^"']*)["']""", 1))
    alt = F.coalesce(F.nullif(alt, F.lit("")), F.lit("Image"))
    return F.coalesce(F.concat(F.lit("!["), alt, F.lit("]("), target, F.lit(")")), tag)


def image_link(link: Column) -> Column:
    head, target = F.regexp_extract(link, r"\A(!\[[^\]]*\]\()", 1), media_target(F.regexp_extract(link, r"\]\(([^)]+)\)\z", 1))
    return F.coalesce(F.concat(head, target, F.lit(")")), link)


def url_pathname(url: Column) -> Column:
    """The object that a signed URL names: its query parameter ``pathname`` (decoded twice) where there is one, else its path (decoded once)."""
    query = F.try_url_decode(F.regexp_extract(url, r"[?&]pathname=([^&#]*)", 1))
    query = F.coalesce(F.try_url_decode(F.replace(query, F.lit("+"), F.lit("%2B"))), query)
    path = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    found = F.when(query != "", query).otherwise(path)
    return F.nullif(F.regexp_replace(found, r"\A/+", ""), F.lit(""))


def bound_to(url: Column, signed: Column) -> Column:
    """JOB_TOKEN_INVALID for a URL that is not https or does not name the path that a token was signed for; else null."""
    right = F.lower(url).startswith("https://") & (url_pathname(url) == F.regexp_replace(signed, r"\A/+", ""))
    return F.when(~F.coalesce(right, F.lit(False)), "JOB_TOKEN_INVALID")


def object_key(day: Column, job: Column, stem: Column, extension: Column, include_media: Column) -> Column:
    """struct<source, result, status>: the keys of a job's objects."""
    prefix = F.concat(F.lit("jobs/"), F.date_format(day, "yyyy-MM-dd"), F.lit("/"), job)
    name = slug(stem)
    result = F.concat(name, F.when(include_media, F.lit("_markdown.zip")).otherwise(F.lit(".md")))
    return F.struct(
        F.concat(prefix, F.lit("/source/"), name, extension).alias("source"),
        F.concat(prefix, F.lit("/result/"), result).alias("result"),
        F.concat(prefix, F.lit("/status.json")).alias("status"),
    )


def belongs_to(path: Column, job: Column) -> Column:
    """Whether a key lies under a job's folder and nowhere else."""
    head = F.regexp_extract(path, r"\A(jobs/\d{4}-\d{2}-\d{2}/)", 1)
    rest = F.substring(path, F.char_length(head) + 1, F.char_length(path))
    return ~path.contains("..") & (head != "") & rest.startswith(F.concat(job, F.lit("/")))


def retention_class(path: Column) -> Column:
    return F.when(path.contains("/source/"), "source").when(path.contains("/result/"), "result").when(path.endswith("/status.json"), "status")


def retention_minutes(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in RETENTION.items()])


def include_media(result_path: Column) -> Column:
    return ~result_path.endswith(".md")


def mime(extension: Column) -> Column:
    return F.coalesce(*[F.when(extension == k, F.lit(v)) for k, v in MIME.items()])
