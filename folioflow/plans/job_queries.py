"""Queries over validation, media, outcomes and the life of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Limits
from ..functions import errors, paths, tokens
from ..operators import blocks, convert, ladder, lifecycle, media, outcome
from ..sources.zipdir import zip_members
from .registry import query, table

#: Limits that both outcomes of every rule occur under in the test tables.
SMALL = Limits(max_members=6, max_expanded_bytes=900_000, max_ratio=30, ratio_checked_from=100_000, max_source_bytes=40_000, max_output_bytes=6_000, max_result_bytes=2_500)


@query("""
    WITH m AS (
      SELECT l_orderkey, count(*) AS members, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS expanded,
             CAST(sum(CAST(round(l_extendedprice) AS BIGINT) // CAST(l_quantity + 10 AS BIGINT)) AS BIGINT) AS compressed,
             bool_or(l_partkey % 50 = 0) AS unsafe
      FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, members, expanded, compressed, unsafe,
           CASE WHEN compressed > 0 THEN expanded / compressed ELSE 0.0 END AS ratio,
           CASE WHEN expanded > 350000 THEN 'FILE_TOO_LARGE' WHEN members > 6 THEN 'OFFICE_ARCHIVE_UNSAFE' WHEN unsafe THEN 'OFFICE_ARCHIVE_UNSAFE'
                WHEN expanded > 300000 THEN 'DOCUMENT_EXPANDS_TOO_LARGE'
                WHEN expanded > 100000 AND CASE WHEN compressed > 0 THEN expanded / compressed ELSE 0.0 END > 40 THEN 'OFFICE_ARCHIVE_UNSAFE' END AS error_code
    FROM m""")
def validation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.round("l_extendedprice").cast("long")
    name = F.when(F.col("l_partkey") % 50 == 0, F.concat(F.lit("../up"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("ppt/slide"), F.col("l_linenumber").cast("string")))
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", name.alias("name"), size.alias("file_size"), F.expr("cast(round(l_extendedprice) as bigint) div cast(l_quantity + 10 as bigint)").alias("compress_size"))
    stats = ladder.archive_stats(members, "l_orderkey")
    limits = Limits(max_members=6, max_expanded_bytes=300_000, max_ratio=40, ratio_checked_from=100_000)
    code = F.coalesce(ladder.first_failure((F.col("expanded") > 350_000, "FILE_TOO_LARGE")), ladder.archive(F.col("members"), F.col("expanded"), F.col("compressed"), F.col("unsafe"), limits))
    return stats.withColumn("error_code", code)


@query("""
    WITH n AS (
      SELECT l_orderkey, list(DISTINCT CASE l_linenumber WHEN 1 THEN '[Content_Types].xml' WHEN 3 THEN 'ppt/presentation.xml' WHEN 2 THEN 'word/document.xml' ELSE 'x' || l_linenumber END) AS names
      FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'pptx' ELSE 'docx' END AS kind,
           array_to_string(list_filter(CASE WHEN l_orderkey % 2 = 0 THEN ['[Content_Types].xml', 'ppt/presentation.xml'] ELSE ['[Content_Types].xml', 'word/document.xml'] END, lambda x: NOT list_contains(names, x)), ',') AS missing
    FROM n""")
def member_required_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    name = F.when(n == 1, "[Content_Types].xml").when(n == 3, "ppt/presentation.xml").when(n == 2, "word/document.xml").otherwise(F.concat(F.lit("x"), n.cast("string")))
    named = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(name).alias("names"))
    kind = F.when(F.col("l_orderkey") % 2 == 0, "pptx").otherwise("docx")
    return named.select("l_orderkey", kind.alias("kind"), F.array_join(ladder.missing_members(kind, F.col("names")), ",").alias("missing"))


#: Text rows as media of documents: a source is a document, its rows come in the order of doc_id.
MEDIA = "SELECT source, doc_id AS seq, doc_id % 7 + 1 AS part_no, doc_id % 4 + 1 AS position, sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents"


def as_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("seq"), (F.col("doc_id") % 7 + 1).alias("part_no"), (F.col("doc_id") % 4 + 1).alias("position"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(".png").alias("extension"))


@query(f"WITH m AS ({MEDIA}) SELECT source, count(*) AS refs, count(DISTINCT digest) AS media_count, min(seq) AS first_seq FROM m GROUP BY source")
def media_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.distinct_count(as_media(spark, sf_dir), "source")


@query(f"""
    WITH m AS ({MEDIA}),
    f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source, digest ORDER BY seq) = 1),
    n AS (SELECT source, digest, printf('slide-%03d-image-%03d.png', part_no, row_number() OVER (PARTITION BY source ORDER BY seq)) AS slide_name, printf('page-%03d-image-%03d.png', part_no, position) AS page_name FROM f)
    SELECT source, seq, digest, slide_name, page_name FROM m JOIN n USING (source, digest)""")
def media_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = as_media(spark, sf_dir)
    slides = media.named(refs, "source").withColumnRenamed("name", "slide_name")
    pages = media.first_occurrences(refs, "source").select("source", "digest", media.numbered("page", F.col("part_no"), F.col("position"), F.col("extension")).alias("page_name"))
    return slides.join(pages, ["source", "digest"]).select("source", "seq", "digest", "slide_name", "page_name")


#: Names that files want, some of them the names that others would get.
WANTED = "'image-' || position || CASE WHEN seq % 5 = 0 THEN '-2' ELSE '' END || '.png'"


@query(f"""
    WITH RECURSIVE m AS ({MEDIA}),
    f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source, digest ORDER BY seq) = 1),
    p AS (SELECT source, seq, {WANTED} AS wanted, row_number() OVER (PARTITION BY source ORDER BY seq) AS i FROM f),
    r AS (
      SELECT source, seq, i, wanted AS name, [wanted] AS used FROM p WHERE i = 1
      UNION ALL
      SELECT source, seq, i, name, list_append(used, name) FROM (
        SELECT p.source, p.seq, p.i, r.used, CASE WHEN NOT list_contains(r.used, p.wanted) THEN p.wanted ELSE
               replace(p.wanted, '.png', '-' || list_filter(range(2, len(r.used) + 3), lambda k: NOT list_contains(r.used, replace(p.wanted, '.png', '-' || k || '.png')))[1] || '.png') END AS name
        FROM r JOIN p ON p.source = r.source AND p.i = r.i + 1))
    SELECT source, seq, name FROM r""")
def media_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = media.first_occurrences(as_media(spark, sf_dir), "source").withColumn("wanted", F.expr(WANTED))
    return media.without_collisions(firsts, "source", "wanted", "seq").select("source", "seq", "name")


@query(f"""
    WITH m AS ({MEDIA}),
    f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source, digest ORDER BY seq) = 1),
    c AS (SELECT *, sum(n_bytes) OVER (PARTITION BY source ORDER BY seq) AS total FROM f)
    SELECT source, count(*) FILTER (total <= 120000) AS media_count, CAST(coalesce(max(total) FILTER (total <= 120000), 0) AS BIGINT) AS media_bytes,
           CASE WHEN bool_or(total > 120000) THEN 'DOCUMENT_EXPANDS_TOO_LARGE' END AS error_code FROM c GROUP BY source""")
def media_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.within_budget(media.first_occurrences(as_media(spark, sf_dir), "source"), 120_000, "source")


@query("""
    WITH w AS (SELECT user_id, event_type || ' ' || CAST(floor(value) AS BIGINT) % 7 AS message, min(event_id) AS seq FROM events GROUP BY ALL),
    l AS (SELECT user_id, list(message ORDER BY seq) AS warnings FROM w GROUP BY user_id)
    SELECT user_id, array_to_string(warnings, ';') AS warnings, array_to_string(warnings[1:8], ';') AS shown, CAST(greatest(len(warnings) - 8, 0) AS INT) AS more FROM l""")
def warning_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat_ws(" ", "event_type", (F.floor("value") % 7).cast("string"))
    lists = blocks.warning_lists(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), message.alias("message")), "user_id")
    return lists.select("user_id", F.array_join("warnings", ";").alias("warnings"), F.array_join("shown", ";").alias("shown"), "more")


@query("""
    WITH d AS (SELECT doc_id, n_chars, doc_id % 3 AS images, least((doc_id % 10) * (doc_id % 7) * 700.0 / 20000.0, 1.0) AS coverage FROM documents)
    SELECT doc_id, coverage, CASE WHEN images > 0 AND n_chars < 40 AND coverage >= 0.5 THEN 'Page ' || (doc_id % 5 + 1) || ' may be scanned or image-based. Text extraction may be incomplete.' END AS warning
    FROM d""")
def scan_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    boxes = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.struct(F.when(i <= doc % 7, doc % 10).otherwise(0).cast("double").alias("w"), F.lit(700.0).alias("h")))
    pages = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (doc % 3).alias("images"), convert.image_coverage(boxes, F.lit(20000.0)).alias("coverage"))
    return pages.select("doc_id", "coverage", F.when(convert.looks_scanned(F.col("images"), F.col("n_chars"), F.col("coverage")), errors.warning("scanned", doc % 5 + 1)).alias("warning"))


@query("""
    WITH e AS (SELECT user_id, event_id, value AS seconds, row_number() OVER w AS page, count(*) OVER (PARTITION BY user_id) AS pages, sum(value) OVER w AS used
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT *, min(page) FILTER (used > 400 AND seconds <= 70) OVER (PARTITION BY user_id) AS stop FROM e)
    SELECT user_id, event_id, page, CASE WHEN pages > 12 THEN 'pages' WHEN page > stop THEN 'stopped' WHEN seconds > 70 THEN 'slow' WHEN page = stop THEN 'over' ELSE 'kept' END AS tables FROM s""")
def table_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of a user's document, their value as the seconds that tables took."""
    by = Window.partitionBy("user_id")
    pages = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("seconds"), F.row_number().over(by.orderBy("event_id")).cast("long").alias("page"), F.count(F.lit(1)).over(by).alias("pages"))
    return outcome.table_budget(pages, "user_id", "page", Limits(max_table_pages=12, table_page_seconds=70, deadline=400, table_reserve_seconds=0)).select("user_id", "event_id", "page", "tables")


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber AS z, CASE WHEN l_tax > 0.06 THEN NULL ELSE CAST(l_quantity AS INT) % 5 END AS top, CASE WHEN l_discount > 0.08 THEN NULL ELSE CAST(l_quantity AS INT) % 3 END AS left_ FROM lineitem)
    SELECT l_orderkey, string_agg(z, ',' ORDER BY coalesce(top, 1000000000), coalesce(left_, 1000000000), z) AS reading FROM s GROUP BY l_orderkey""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    far = F.lit(10**9)
    key = F.struct(F.coalesce(F.when(F.col("l_tax") <= 0.06, q % 5), far).alias("top"), F.coalesce(F.when(F.col("l_discount") <= 0.08, q % 3), far).alias("left"), F.col("l_linenumber").alias("z"))
    shapes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(key).alias("shapes"))

    def item(k):
        """A shape as an extractor gives it; what it does not have is added after the shuffle."""
        own = {"part_no": F.lit(1), "kind": F.lit("frame"), "place": F.lit(1), "key": F.array(k["top"], k["left"], k["z"]).cast("array<bigint>"), "text": k["z"].cast("string")}
        return F.struct(*[v.alias(name) for name, v in (own | {f: F.lit(None) for f in convert.FIELDS if f not in own}).items()])

    return shapes.select("l_orderkey", F.array_join(F.transform(convert.in_order(F.transform("shapes", item)), lambda i: i["text"]), ",").alias("reading"))


@query("""
    WITH u AS (SELECT CASE WHEN l_shipdate < timestamp '1993-01-01' THEN l_partkey ELSE -l_partkey END AS k FROM lineitem)
    SELECT 'referenced' AS kind, p_partkey FROM part WHERE p_partkey IN (SELECT k FROM u)
    UNION ALL SELECT 'unreferenced', p_partkey FROM part WHERE p_partkey NOT IN (SELECT k FROM u)""")
def unreferenced_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as media, lines as references: those shipped since 1993 refer to other media."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    early = F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz")
    used = table(spark, sf_dir, "lineitem").select(F.when(early, F.col("l_partkey")).otherwise(-F.col("l_partkey")).alias("p_partkey"))
    return media.by_reference(part, used, "p_partkey")


@query("""
    WITH d AS (SELECT doc_id, n_chars AS md, CASE WHEN quality IS NULL THEN 0 ELSE quality * n_chars * 2 END AS media, coalesce(quality, 0) AS media_count, doc_id % 2 = 0 AS include_media
               FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, CASE WHEN include_media AND media_count > 0 THEN 'zip' ELSE 'md' END AS shape,
           CASE WHEN include_media AND media_count > 0 THEN 'application/zip' ELSE 'text/markdown; charset=utf-8' END AS content_type,
           CASE WHEN md + media > 6000 THEN 'DOCUMENT_EXPANDS_TOO_LARGE' WHEN md > 2500 THEN 'RESULT_TOO_LARGE' END AS error_code FROM d""")
def output_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.coalesce("quality", F.lit(0))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    kind = outcome.shape(F.col("doc_id") % 2 == 0, quality)
    return d.select("doc_id", kind.alias("shape"), outcome.content_type(kind).alias("content_type"), outcome.quota(F.col("n_chars"), quality * F.col("n_chars") * 2, F.col("n_chars"), SMALL).alias("error_code"))


#: Events as stages of a user's job.
STAGE = "CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'view' THEN 'downloading' WHEN 'click' THEN 'converting' WHEN 'error' THEN CASE WHEN value > 60 THEN 'failed' ELSE 'uploading' END ELSE CASE WHEN value > 75 THEN 'complete' ELSE 'uploading' END END"
SQL_PROGRESS = "CASE stage " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in errors.PROGRESS.items()) + " END"


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("ts"), F.expr(STAGE).alias("stage"))


SQL_STATUS = f"""
    WITH e AS (SELECT user_id AS job_id, ts, {STAGE} AS stage FROM events),
    k AS (SELECT *, min(ts) FILTER (stage IN ('complete', 'failed')) OVER (PARTITION BY job_id) AS e_ts FROM e),
    s AS (SELECT * FROM k WHERE e_ts IS NULL OR ts <= e_ts QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC) = 1)
    SELECT job_id, stage, ts, {SQL_PROGRESS} AS progress, stage IN ('complete', 'failed') AS done, stage <> 'failed' AS ok FROM s"""


@query(SQL_STATUS)
def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest_status(stages(spark, sf_dir))


@query(f"""
    WITH e AS (SELECT user_id AS job_id, event_id, ts, {STAGE} AS stage FROM events),
    k AS (SELECT *, min(ts) FILTER (stage IN ('complete', 'failed')) OVER (PARTITION BY job_id) AS e_ts FROM e),
    b AS (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY ts) AS before FROM k WHERE e_ts IS NULL OR ts <= e_ts)
    SELECT job_id, event_id, ts, stage, before FROM b WHERE before IS NULL OR before <> stage""")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.status_changes(lifecycle.before_settled(stages(spark, sf_dir)))


@query(f"""
    WITH s AS ({SQL_STATUS})
    SELECT job_id, '{{"job_id":"' || job_id || '","stage":"' || stage || '","progress":' || progress || ',"done":' || done || ',"ok":' || ok || CASE WHEN ok THEN '' ELSE ',"code":"CONVERSION_FAILED"' END || '}}' AS payload FROM s""")
def status_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_latest(spark, sf_dir).select("job_id", errors.status_payload(F.col("job_id"), F.col("stage"), F.lit("CONVERSION_FAILED")).alias("payload"))


@query("""
    SELECT event_id, user_id, time_bucket(INTERVAL '1 day', ts) AS window_start, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 day', ts) ORDER BY ts, event_id) AS place,
           row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 day', ts) ORDER BY ts, event_id) <= 5 AS admitted FROM events""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return lifecycle.admitted(e, "user_id", "ts", 5, 86_400, "event_id").drop("ts")


#: Events as stored objects, and the time of the sweep.
KEY = "'jobs/2024-01-01/' || user_id || CASE event_type WHEN 'view' THEN '/source/a.pdf' WHEN 'click' THEN '/result/a.zip' WHEN 'purchase' THEN '/status.json' ELSE '/other' END || '#' || event_id"
PATH = "CASE WHEN event_type = 'purchase' THEN 'jobs/2024-01-01/' || user_id || '-' || event_id || '/status.json' ELSE " + KEY + " END"
NOW = "2024-01-15 12:00:00"
SQL_EXPIRED = f"""
    l AS (SELECT event_id, {PATH} AS path, ts FROM events),
    c AS (SELECT *, CASE WHEN path LIKE '%/source/%' THEN 'source' WHEN path LIKE '%/result/%' THEN 'result' WHEN path LIKE '%/status.json' THEN 'status' END AS class FROM l),
    x AS (SELECT * FROM c WHERE ts <= timestamp '{NOW}' - to_minutes(CASE class WHEN 'source' THEN 60 WHEN 'result' THEN 120 WHEN 'status' THEN 120 END))"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(PATH).alias("path"), F.col("ts").cast("timestamp").alias("uploaded_at"))


@query(f"WITH {SQL_EXPIRED} SELECT class, count(*) AS n FROM x GROUP BY class")
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.sweep_counts(lifecycle.expired(listing(spark, sf_dir), F.lit(NOW).cast("timestamp")))


@query(f"""
    WITH {SQL_EXPIRED},
    p AS (SELECT c.*, x.path IS NOT NULL AS gone, ceil(row_number() OVER (ORDER BY c.path) / 250.0) AS page FROM c LEFT JOIN x USING (path)),
    t AS (SELECT page, sum(count(*) FILTER (gone)) OVER (ORDER BY page) AS total FROM p GROUP BY page),
    s AS (SELECT coalesce(min(page) FILTER (total >= 500), max(page)) AS stop FROM t)
    SELECT event_id, path, class FROM p, s WHERE gone AND page <= stop""")
def retention_paged_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.paged_deletions(listing(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("event_id", "path", "class")


SQL_CATALOG = "(VALUES " + ", ".join(f"('{c}', {s}, '{m}')" for c, s, m in errors.ERRORS) + ") AS k(code, http_status, message)"
CODE = "list_extract([" + ", ".join(f"'{c}'" for c, _, _ in errors.ERRORS) + ", 'NOT_A_CODE'], CAST(event_id % 18 + 1 AS INT))"


@query(f"SELECT event_id, e.code, http_status, message FROM (SELECT event_id, {CODE} AS code FROM events) e LEFT JOIN {SQL_CATALOG} ON e.code = k.code")
def error_catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c, _, _ in errors.ERRORS], F.lit("NOT_A_CODE"))
    e = table(spark, sf_dir, "events").select("event_id", F.get(codes, (F.col("event_id") % 18).cast("int")).alias("code"))
    # 17 fixed rows
    return e.join(F.broadcast(errors.error_catalog(spark)), "code", "left").select("event_id", "code", "http_status", "message")


@query("""
    WITH f AS (SELECT source, 'doc-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '/é.png' END AS path, octet_length(encode(text)) AS n FROM documents)
    SELECT source, string_agg(source || '_markdown/' || path, chr(10) ORDER BY encode(path)) AS members, CAST(sum(n) AS BIGINT) AS total FROM f GROUP BY source""")
def zip_member_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise("/é.png"))
    files = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_list(path)).alias("paths"), F.sum(F.octet_length("text").cast("long")).alias("total"))
    return files.select("source", F.array_join(F.transform("paths", lambda p: outcome.member_path(F.col("source"), p)), "\n").alias("members"), "total")


@query("""
    SELECT doc_id, CAST(1 + (doc_id % 3) AS BIGINT) AS members, CAST(octet_length(encode(text)) + CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 4 END AS BIGINT) AS expanded, 'd' || doc_id || '_markdown/' || 'd' || doc_id || '.md' AS first_name, CAST(NULL AS VARCHAR) AS error_code FROM documents""")
def package_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into archives, whose directories are read again."""
    stem = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    file = lambda path, content: F.struct(path.alias("path"), content.cast("binary").alias("content"))
    media_files = F.slice(F.array(file(F.lit("media/a.png"), F.lit("abc")), file(F.lit("media/b.png"), F.lit("d"))), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    trees = table(spark, sf_dir, "documents").select("doc_id", stem.alias("stem"), F.concat(media_files, F.array(file(F.concat(stem, F.lit(".md")), F.col("text")))).alias("files"))
    made = outcome.packaged(trees).withColumn("m", zip_members(F.col("content")))
    return made.select("doc_id", F.size("m").cast("long").alias("members"), F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x["file_size"]).alias("expanded"), F.get("m", 0)["name"].alias("first_name"), "error_code")


SECRET = b"0123456789abcdef0123456789abcdef"


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'JOB_TOKEN_INVALID' WHEN 1000 + o_orderkey % 200 + 60 < 1100 THEN 'JOB_TOKEN_EXPIRED' END AS code,
           CASE WHEN o_orderkey % 5 = 0 OR 1000 + o_orderkey % 200 + 60 < 1100 THEN NULL ELSE 'ä ' || o_orderpriority || '.pdf' END AS filename FROM orders""")
def token_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens minted for orders, every fifth one forged, and verified at a fixed time."""
    key = F.col("o_orderkey")
    claims = {"exp": 1000 + key % 200, "filename": F.concat(F.lit("ä "), F.col("o_orderpriority"), F.lit(".pdf")), "job_id": key.cast("string"), "result_path": F.lit("jobs/r"), "source_path": F.lit("jobs/s"), "source_size": key}
    minted = table(spark, sf_dir, "orders").select("o_orderkey", tokens.mint(claims, SECRET).alias("token"))
    forged = F.when(key % 5 == 0, F.concat(F.lit("A"), F.substring("token", 2, 10**6))).otherwise(F.col("token"))
    return minted.select("o_orderkey", tokens.verify(forged, F.lit(1100), SECRET).alias("v")).select("o_orderkey", "v.code", F.col("v.claims.filename").alias("filename"))


def objects_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as objects; those without credit under keys that nobody asks for."""
    return table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("o_custkey"), F.lit(True).alias("there"))


JOB = "CASE o_orderkey % 9 WHEN 0 THEN NULL ELSE 'j' || o_orderkey END"
SOURCE = "CASE o_orderkey % 7 WHEN 0 THEN '/jobs/2024-01-01/j' || o_orderkey || '/source/a.pdf' WHEN 1 THEN 'jobs/2024-01-01/j' || o_orderkey || '/other/a.pdf' WHEN 2 THEN 'jobs/2024-01-01/j' || o_orderkey || '/source/../a.pdf' WHEN 3 THEN 'jobs/2024-01-01/j' || o_orderkey || '/source/a.exe' ELSE 'jobs/2024-01-01/j' || o_orderkey || '/source/a.pdf' END"
RESULT = "'jobs/2024-01-01/j' || o_orderkey || '/result/a' || CASE WHEN o_orderkey % 4 = 0 THEN '.md' ELSE '_markdown.zip' END"


@query(f"""
    WITH j AS (SELECT o_orderkey, {JOB} AS job, {SOURCE} AS source, {RESULT} AS result, o_orderkey % 3 <> 0 AS media, c_custkey IS NOT NULL AS there, CAST(o_totalprice AS BIGINT) - 20000 AS size
               FROM orders LEFT JOIN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END AS c_custkey FROM customer) ON o_custkey = c_custkey)
    SELECT o_orderkey, CASE
      WHEN job IS NULL THEN 'JOB_TOKEN_INVALID'
      WHEN source LIKE '%..%' OR result LIKE '%..%' OR NOT source LIKE 'jobs/2024-01-01/' || job || '/%' OR NOT result LIKE 'jobs/2024-01-01/' || job || '/%' THEN 'JOB_TOKEN_INVALID'
      WHEN NOT source LIKE '%/source/%' THEN 'JOB_TOKEN_INVALID'
      WHEN NOT result LIKE CASE WHEN media THEN '%.zip' ELSE '%.md' END THEN 'JOB_TOKEN_INVALID'
      WHEN source LIKE '%.exe' THEN 'UNSUPPORTED_FILE_TYPE'
      WHEN NOT there THEN 'BLOB_NOT_FOUND' WHEN size <= 0 THEN 'INVALID_FILE_FORMAT' WHEN size > 40000 THEN 'FILE_TOO_LARGE' END AS code, NOT result LIKE '%.md' AS include_media FROM j""")
def prepare_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs, customers in credit as the objects that exist."""
    objects = objects_there(spark, sf_dir)
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(JOB).alias("job"), F.expr(SOURCE).alias("source"), F.expr(RESULT).alias("result"), (F.rint("o_totalprice").cast("long") - 20000).alias("size"))
    jobs = jobs.join(objects, "o_custkey", "left")
    code = ladder.prepared(F.col("job"), F.col("source"), F.col("result"), F.col("o_orderkey") % 3 != 0, F.col("there"), F.col("size"), SMALL)
    return jobs.select("o_orderkey", code.alias("code"), paths.include_media(F.col("result")).alias("include_media"))


@query("""
    SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'unknown' END AS step, substring(repeat(props, 3), 1, 80) AS detail FROM events""")
def trace_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = errors.traced(F.col("event_type"), F.repeat("props", F.lit(3)), ("view", "click", "purchase"))
    return table(spark, sf_dir, "events").withColumn("t", traced).select("event_id", "t.step", "t.detail")


#: Events as reservations in a user's workspace, and releases that may be larger than what is reserved.
AMOUNT = "CAST(CASE event_type WHEN 'error' THEN -9 WHEN 'purchase' THEN 5 WHEN 'signup' THEN -2 ELSE 2 END AS BIGINT)"


@query(f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, {AMOUNT} AS amount, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    r AS (
      SELECT user_id, event_id, amount, i, greatest(amount, 0) AS reserved, true AS fits FROM e WHERE i = 1
      UNION ALL
      SELECT e.user_id, e.event_id, e.amount, e.i, CASE WHEN e.amount > 0 AND r.reserved + e.amount > 6 THEN r.reserved ELSE greatest(r.reserved + e.amount, 0) END, NOT (e.amount > 0 AND r.reserved + e.amount > 6)
      FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, event_id, amount, reserved, fits FROM r""")
def admission_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(AMOUNT.replace("BIGINT", "bigint")).alias("amount"))
    return lifecycle.admission_replay(e, 6, "event_id", group="user_id")


@query("""
    WITH d AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '89504E470D0A1A0A00' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '474946383961' WHEN 3 THEN '424D00' WHEN 4 THEN '49492A00' WHEN 5 THEN '5249464600000000574542505650' WHEN 6 THEN '255044462D312E37' ELSE 'D0CF11E0A1B11AE1' END AS h FROM documents)
    SELECT doc_id, CASE WHEN h LIKE '8950%' THEN '.png' WHEN h LIKE 'FFD8FF%' THEN '.jpg' WHEN h LIKE '4749%' THEN '.gif' WHEN h LIKE '424D%' THEN '.bmp' WHEN h LIKE '4949%' THEN '.tiff' WHEN h LIKE '5249%' THEN '.webp' ELSE '.png' END AS extension,
           CASE WHEN h LIKE '255044462D%' THEN NULL ELSE 'INVALID_FILE_FORMAT' END AS as_pdf,
           CASE WHEN h LIKE 'D0CF11E0A1B11AE1%' THEN 'PASSWORD_PROTECTED' ELSE 'INVALID_FILE_FORMAT' END AS as_docx FROM d""")
def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.binary import image_extension

    heads = ("89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "424D00", "49492A00", "5249464600000000574542505650", "255044462D312E37", "D0CF11E0A1B11AE1")
    head = F.unhex(F.get(F.array(*map(F.lit, heads)), (F.col("doc_id") % 8).cast("int")))
    d = table(spark, sf_dir, "documents").select("doc_id", head.alias("head"))
    return d.select("doc_id", image_extension(F.col("head")).alias("extension"), ladder.content(F.lit("pdf"), F.col("head")).alias("as_pdf"), ladder.content(F.lit("docx"), F.col("head")).alias("as_docx"))


@query(r"""
    SELECT event_id, replace(replace(rtrim(base64(encode('ü' || props)), '='), '+', '-'), '/', '_') AS encoded, 'ü' || props AS decoded FROM events""")
def base64url_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("ü"), F.col("props"))
    encoded = table(spark, sf_dir, "events").select("event_id", tokens.base64url(raw.cast("binary")).alias("encoded"))
    return encoded.withColumn("decoded", tokens.from_base64url(F.col("encoded")).cast("string"))



@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'JOB_TOKEN_INVALID' WHEN 1000 + o_orderkey % 200 < 1100 THEN 'JOB_TOKEN_EXPIRED' WHEN o_orderkey % 7 = 0 THEN 'JOB_TOKEN_INVALID' WHEN c_custkey IS NULL THEN 'BLOB_NOT_FOUND' END AS code
    FROM orders LEFT JOIN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END AS c_custkey FROM customer) ON o_custkey = c_custkey""")
def download_authorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests for results: token, signed path, existence of the object."""
    key = F.col("o_orderkey")
    claims = {"exp": 1000 + key % 200, "filename": F.lit("a.pdf"), "job_id": key.cast("string"), "result_path": F.concat(F.lit("jobs/"), key.cast("string")), "source_path": F.lit("jobs/s"), "source_size": key}
    objects = objects_there(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").join(objects, "o_custkey", "left").select("o_orderkey", "there", tokens.mint(claims, SECRET).alias("token"))
    forged = F.when(key % 5 == 0, F.concat(F.lit("A"), F.substring("token", 2, 10**6))).otherwise(F.col("token"))
    verified = asked.withColumn("v", tokens.verify(forged, F.lit(1100), SECRET, skew=0))
    path = F.concat(F.lit("jobs/"), F.when(key % 7 == 0, "other").otherwise(key.cast("string")))
    return verified.select("o_orderkey", ladder.downloadable(F.col("v.code"), F.col("v.claims.result_path"), path, F.col("there")).alias("code"))


#: URLs of a job's source: encoded twice, once, not by https, of another job, with two strokes, none.
BOUND = "CASE o_orderkey % 6 WHEN 0 THEN 'https://s.example/get?pathname=jobs%252F' || o_orderkey || '%252Fa%2520b.pdf&sig=1' WHEN 1 THEN 'https://s.example/jobs/' || o_orderkey || '/a%20b.pdf?sig=1' WHEN 2 THEN 'http://s.example/jobs/' || o_orderkey || '/a%20b.pdf' WHEN 3 THEN 'https://s.example/jobs/' || (o_orderkey + 1) || '/a%20b.pdf' WHEN 4 THEN 'HTTPS://s.example//jobs/' || o_orderkey || '/a%20b.pdf' END"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (2, 3, 5) THEN 'JOB_TOKEN_INVALID' END AS code FROM orders")
def url_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs whose URLs must name the path that was signed."""
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(BOUND).alias("url"), F.expr("'/jobs/' || o_orderkey || '/a b.pdf'").alias("signed"))
    return jobs.select("o_orderkey", paths.bound_to(F.col("url"), F.col("signed")).alias("code"))


UPLOAD = "CASE p_partkey % 5 WHEN 0 THEN 'jobs/2024-01-01/j' || p_partkey || '/source/a.pdf' WHEN 1 THEN 'jobs/2024-01-01/j' || p_partkey || '/result/a.pdf' WHEN 2 THEN 'jobs/2024-01-01/j' || p_partkey || '/source/a.xlsx' WHEN 3 THEN 'x/source/a.pdf' ELSE 'jobs/2024-01-01/j' || p_partkey || '/source/a.DOCX' END"


@query(f"""
    SELECT p_partkey, path, CASE p_partkey % 5 WHEN 1 THEN 'JOB_TOKEN_INVALID' WHEN 3 THEN 'JOB_TOKEN_INVALID' WHEN 2 THEN 'UNSUPPORTED_FILE_TYPE' END AS error_code,
           CASE p_partkey % 5 WHEN 0 THEN '{paths.MIME[".pdf"]}' WHEN 4 THEN '{paths.MIME[".docx"]}' END AS content_type,
           CASE WHEN p_partkey % 5 IN (0, 4) THEN CAST(104857600 AS INT) END AS max_bytes, CASE WHEN p_partkey % 5 IN (0, 4) THEN CAST(20 AS INT) END AS minutes
    FROM (SELECT p_partkey, {UPLOAD} AS path FROM part)""")
def upload_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select("p_partkey", F.expr(UPLOAD).alias("path"))
    return made.withColumn("u", ladder.uploadable(F.col("path"))).select("p_partkey", "path", "u.*")


@query(f"""
    WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d %H') AS job_id, ts, {STAGE} AS stage FROM events)
    SELECT job_id, min(ts) AS began, 'CONVERSION_TIMEOUT' AS error_code FROM e GROUP BY job_id
    HAVING NOT bool_or(stage IN ('complete', 'failed')) AND min(ts) < timestamp '2024-01-10 00:00:00' - INTERVAL 720 SECOND""")
def overdue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of one hour as a job: some end, some do not, some began too late to be overdue."""
    hourly = stages(spark, sf_dir).withColumn("job_id", F.concat(F.col("job_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd HH")))
    return lifecycle.overdue(hourly, F.lit("2024-01-10 00:00:00").cast("timestamp"))


@query("""
    WITH r AS (SELECT o_custkey AS job_id, max(o_totalprice) > 300000 AS ok, CASE WHEN min(o_totalprice) > 50000 THEN 'CONVERSION_TIMEOUT' END AS code FROM orders GROUP BY o_custkey),
    p AS (SELECT c_custkey AS job_id, c_acctbal > 5000 AS ok, 'DOWNLOAD_FAILED' AS code FROM customer)
    SELECT job_id, coalesce(r.ok, false) OR coalesce(p.ok, false) AS ok, CASE WHEN NOT (coalesce(r.ok, false) OR coalesce(p.ok, false)) THEN coalesce(r.code, p.code, 'CONVERSION_FAILED') END AS code
    FROM r FULL JOIN p USING (job_id)""")
def settled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    response = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg((F.max("o_totalprice") > 300_000).alias("ok"), F.when(F.min("o_totalprice") > 50_000, "CONVERSION_TIMEOUT").alias("code"))
    polled = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_acctbal") > 5000).alias("ok"), F.lit("DOWNLOAD_FAILED").alias("code"))
    return lifecycle.settled(response, polled)


@query("""
    WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id, CASE event_type WHEN 'error' THEN false WHEN 'view' THEN NULL WHEN 'click' THEN false ELSE value > 40 END AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    r AS (SELECT job_id, event_id, i, CASE WHEN ok IS NULL OR ok THEN 0 ELSE 1 END AS failures FROM e WHERE i = 1
          UNION ALL SELECT e.job_id, e.event_id, e.i, CASE WHEN e.ok IS NULL THEN r.failures WHEN e.ok THEN 0 ELSE r.failures + 1 END FROM r JOIN e ON e.job_id = r.job_id AND e.i = r.i + 1)
    SELECT job_id, min(event_id) AS event_id, 'SERVICE_UNAVAILABLE' AS error_code FROM r WHERE failures >= 8 GROUP BY job_id""")
def poll_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls of a user's job: answers, failures, and polls that find no status yet."""
    ok = F.expr("CASE event_type WHEN 'error' THEN false WHEN 'view' THEN NULL WHEN 'click' THEN false ELSE value > 40 END")
    return lifecycle.lost_contact(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", ok.alias("ok")), at="event_id")


@query(f"""
    WITH e AS (SELECT user_id AS job_id, event_id, ts, {STAGE} AS stage FROM events),
    p AS (SELECT *, {SQL_PROGRESS} AS progress FROM e),
    b AS (SELECT *, lag(stage) OVER w AS last, lag(progress) OVER w AS reached FROM p WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
    SELECT job_id, event_id, stage, last IS NULL OR (last NOT IN ('complete', 'failed') AND progress >= reached) AS allowed FROM b""")
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.out_of_order(stages(spark, sf_dir)).select("job_id", "event_id", "stage", "allowed")
