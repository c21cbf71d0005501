"""Documents to Markdown and media: one row per document from the scan to the outcome, so nothing is shuffled.

Only the extraction runs in Python. What it finds is ordered, named, de-duplicated, held
against its budget and rendered by expressions over the row's arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Limits
from ..functions import binary, errors, gfm
from ..functions.bind import let
from ..functions.text import alt_text, base_name, cleaned, page_heading, safe_stem, slide_heading, squeezed
from ..sources import files
from ..sources.extract import extracted
from ..sources.items import AFTER
from ..sources.zipdir import zip_members
from . import ladder, outcome


def screened(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """docs (path, length, content) with source_type and error_code: names and sizes, then first bytes, then the archive's directory."""
    rows = docs.withColumn("source_type", ladder.source_type(F.col("path")))
    rows = rows.withColumn("error_code", F.coalesce(ladder.declared(F.col("path"), F.col("length"), limits), ladder.content(F.col("source_type"), F.substring("content", 1, 8))))
    office = F.col("error_code").isNull() & (F.col("source_type") != "pdf")
    rows = rows.withColumn("members", zip_members(F.when(office, F.col("content"))))
    total = lambda name: F.aggregate("members", F.lit(0).cast("long"), lambda n, m: n + m[name])
    unsafe = F.exists("members", lambda m: ladder.unsafe_member(m["name"]))
    code = F.when(F.col("members").isNull(), "INVALID_FILE_FORMAT").otherwise(
        F.coalesce(
            F.when(F.size(ladder.missing_members(F.col("source_type"), F.transform("members", lambda m: m["name"]))) > 0, "INVALID_FILE_FORMAT"),
            ladder.archive(F.size("members"), total("file_size"), total("compress_size"), unsafe, limits),
        )
    )
    return rows.withColumn("error_code", F.when(office, code).otherwise(F.col("error_code"))).drop("members")


def block(item: Column, names: Column) -> Column:
    """The Markdown of an item; "" for what is none. names maps digests to files."""
    number, kind = item["part_no"], item["kind"]
    ruled = lambda heading: F.when(number > 1, F.concat(F.lit("---\n\n"), heading)).otherwise(heading)
    described = F.concat(F.when(item["position"].isNull(), "Slide ").otherwise("Page "), number.cast("string"), F.lit(" image"))
    alt = F.when(item["position"].isNull(), alt_text(item["alt"], described)).otherwise(described)
    return (
        F.when(kind == "slide", ruled(slide_heading(number, item["text"])))
        .when(kind == "page", F.concat(ruled(page_heading(number)), F.lit("\n\n"), item["text"]))
        .when(kind == "frame", gfm.text_frame(item["paragraphs"]))
        .when(kind == "table", gfm.table(item["rows"]))
        .when(kind == "ptable", gfm.table(item["rows"], numbered_header=True))
        .when(kind == "raw", item["text"])
        .when(kind == "image", F.concat(F.lit("!["), alt, F.lit("](media/"), F.element_at(names, item["digest"]), F.lit(")")))
        .when((kind == "notes") & (squeezed(item["text"]) != ""), F.concat(F.lit("**Speaker notes:** "), squeezed(item["text"])))
        .otherwise(F.lit(""))
    )


FIELDS = ("part_no", "kind", "paragraphs", "rows", "ext", "alt", "position", "boxes", "area", "digest", "content")


def in_order(items: Column) -> Column:
    """The items by part, place, key and where they were found; the text of pages is cleaned."""

    def placed(i: Column, n: Column) -> Column:
        text = F.when(i["kind"] == "page", cleaned(F.coalesce(i["text"], F.lit("")))).otherwise(i["text"])
        at = F.struct(i["part_no"].alias("part_no"), i["place"].alias("place"), i["key"].alias("key"), n.alias("seq"))
        return F.struct(at.alias("at"), text.alias("text"), *[i[f].alias(f) for f in FIELDS])

    return F.array_sort(F.transform(items, placed))


def file_name(i: Column, n: Column) -> Column:
    """The name of the n-th distinct file (from 0), first met at item i."""
    ext = binary.image_extension(i["content"], i["ext"])
    slide = F.concat(F.format_string("slide-%03d-image-%03d", i["part_no"], n + 1), ext)
    page = F.concat(F.format_string("page-%03d-image-%03d", i["part_no"], i["position"]), ext)
    return F.when(i["kind"] == "file", F.regexp_replace(i["alt"], "^media/", "")).when(i["position"].isNull(), slide).otherwise(page)


#: Under so many characters, and from such a share of the page on, a page with images is taken for a scan.
SCAN_CHARS, SCAN_COVERAGE = 40, 0.5


def looks_scanned(images: Column, chars: Column, coverage: Column) -> Column:
    return (images > 0) & (chars < SCAN_CHARS) & (coverage >= SCAN_COVERAGE)


def image_coverage(boxes: Column, area: Column) -> Column:
    """The share of a page that its images (ARRAY of w, h) cover, overlaps counted twice, at most 1; boxes without a size are skipped."""
    total = F.aggregate(boxes, F.lit(0.0), lambda acc, b: acc + F.coalesce(F.when((b["w"] > 0) & (b["h"] > 0), b["w"] * b["h"]), F.lit(0.0)))
    return F.when(area > 0, F.least(total / area, F.lit(1.0))).otherwise(F.lit(0.0))


def warnings(items: Column) -> Column:
    """Distinct warnings in the order of their places; a page with images, little text and much covered is taken for a scan."""
    warned = F.transform(F.filter(items, lambda i: i["kind"] == "warning"), lambda i: F.struct(i["at"].alias("at"), i["text"].alias("text")))
    scans = F.filter(items, lambda i: (i["kind"] == "page") & looks_scanned(i["position"], F.char_length(i["text"]), image_coverage(i["boxes"], i["area"])))

    def scanned(i: Column) -> Column:
        at = F.struct(i["part_no"].alias("part_no"), F.lit(AFTER).alias("place"), i["at"]["key"].alias("key"), i["at"]["seq"].alias("seq"))
        return F.struct(at.alias("at"), errors.warning("scanned", i["part_no"]).alias("text"))

    return F.array_distinct(F.transform(F.array_sort(F.concat(warned, F.transform(scans, scanned))), lambda w: w["text"]))


def rendered(items: Column) -> Column:
    """struct<markdown, media, warnings>: everything a document becomes, from its items."""

    def with_files(items: Column, firsts: Column, files: Column) -> Column:
        names = F.map_from_arrays(F.transform(firsts, lambda i: i["digest"]), files)
        markdown = let(names, lambda names: gfm.document(F.transform(items, lambda i: block(i, names))))
        media = F.transform(firsts, lambda i, n: F.struct(F.get(files, n).alias("name"), i["content"].alias("content")))
        return F.struct(markdown.alias("markdown"), media.alias("media"), warnings(items).alias("warnings"))

    def with_images(items: Column, images: Column) -> Column:
        first = lambda digests: F.filter(images, lambda i, n: F.array_position(digests, i["digest"]) == n + 1)
        firsts = let(F.transform(images, lambda i: i["digest"]), first)
        return let(firsts, lambda firsts: let(F.transform(firsts, file_name), lambda files: with_files(items, firsts, files)))

    return let(in_order(items), lambda items: let(F.filter(items, lambda i: i["kind"].isin("image", "file")), lambda images: with_images(items, images)))


def converted(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """path, stem, source_type, markdown, media (ARRAY of name, content), pages_or_slides, media_count, warnings, shape, content_type, error_code for each of docs (path, length, content).

    A document that fails has only its error_code.
    """
    rows = extracted(screened(docs, limits), limits)
    rows = rows.withColumn("r", F.when(F.col("error_code").isNull(), rendered(F.col("items")))).select("path", "source_type", "error_code", "parts", "r.*")
    media_bytes = F.aggregate("media", F.lit(0).cast("long"), lambda n, m: n + F.octet_length(m["content"]))
    markdown_bytes = F.octet_length("markdown").cast("long")
    code = F.coalesce(F.col("error_code"), F.when(media_bytes > limits.max_output_bytes, "DOCUMENT_EXPANDS_TOO_LARGE"), outcome.quota(markdown_bytes, media_bytes, F.lit(0), limits))
    rows = rows.withColumn("error_code", code)
    holds = F.col("error_code").isNull()
    kept = lambda c: F.when(holds, c)
    shape = outcome.shape(F.lit(limits.include_media), F.size("media"))
    return rows.select(
        "path",
        "source_type",
        kept(F.col("markdown")).alias("markdown"),
        kept(F.col("media")).alias("media"),
        kept(F.when(F.col("source_type") != "docx", F.col("parts"))).alias("pages_or_slides"),
        kept(F.size("media")).alias("media_count"),
        kept(F.col("warnings")).alias("warnings"),
        kept(shape).alias("shape"),
        kept(outcome.content_type(shape)).alias("content_type"),
        "error_code",
        safe_stem(base_name(F.col("path"))).alias("stem"),
    )


def tree() -> Column:
    """The files that an outcome is made of: its Markdown first, then its media."""
    member = lambda path, content: F.struct(path.alias("path"), content.alias("content"))
    return F.concat(F.array(member(F.concat("stem", F.lit(".md")), F.col("markdown").cast("binary"))), F.transform("media", lambda m: member(F.concat(F.lit("media/"), m["name"]), m["content"])))


def delivered(outcomes: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """path, name, content, error_code: the file that each document becomes, an archive or bare Markdown, made in one pass."""
    return outcome.files_of(outcomes.where("error_code IS NULL").select("path", "stem", "shape", tree().alias("files")), "path", limits)


def convert_folder(spark: SparkSession, folder: str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Outcomes of all files under a folder. Names and sizes are judged from the listing; only files that pass are opened."""
    listed = files.listing(spark, folder)
    refused = listed.select("path", ladder.source_type(F.col("path")).alias("source_type"), ladder.declared(F.col("path"), F.col("length"), limits).alias("error_code")).where("error_code IS NOT NULL")
    supported = ladder.source_type(F.col("path")).isNotNull()
    opened = converted(files.documents(spark, folder, limits.max_source_bytes).where(supported), limits)
    return opened.unionByName(refused.withColumn("stem", safe_stem(base_name(F.col("path")))), allowMissingColumns=True)
