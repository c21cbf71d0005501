"""Queries over text expressions: cleaning, tables, names, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gfm, paths, text
from ..operators import blocks, ladder
from .registry import query, table

W, INLINE, LINE_END = text.WHITE, text.INLINE, text.LINE_END


def sql_strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{W}+', ''), '{W}+\z', '')"


def sql_cleaned(x: str) -> str:
    lines = rf"regexp_replace(regexp_replace({x}, '{LINE_END}', chr(10), 'g'), '{INLINE}+\n', chr(10), 'g')"
    return sql_strip(rf"regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_squeezed(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{W}+', ' ', 'g')")


def sql_cell(x: str) -> str:
    return sql_strip(f"replace(replace(coalesce({x}, ''), '|', '\\|'), chr(10), ' ')")


@query(f"""
    WITH b AS (
      SELECT conv_id, turn, 0 AS place, '---' AS block FROM conversations WHERE turn > 0
      UNION ALL
      SELECT conv_id, turn, 1, '## Slide ' || (turn + 1) || CASE WHEN {sql_squeezed("coalesce(role, '')")} = '' THEN '' ELSE ' — ' || {sql_squeezed("role")} END FROM conversations
      UNION ALL
      SELECT conv_id, turn, 2, {sql_cleaned("coalesce(text, '')")} FROM conversations)
    SELECT conv_id, {sql_strip("string_agg(" + sql_strip("block") + ", chr(10) || chr(10) ORDER BY turn, place) FILTER (" + sql_strip("block") + " <> '')")} || chr(10) AS markdown
    FROM b GROUP BY conv_id""")
def conv_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.conversation_documents(table(spark, sf_dir, "conversations"))


#: What is put into texts so that every rule of the cleaner has something to do.
DIRT = "' \\t' || chr(160) || chr(13) || chr(10) || chr(8232) || '  ' || chr(10) || chr(11) || chr(12)"


@query(f"SELECT doc_id, {sql_cleaned(f'''({DIRT.replace(chr(92) + 't', chr(9))} || replace(text, '. ', '.' || chr(160) || chr(13) || chr(10) || chr(10) || chr(10) || chr(133) || ' ') || chr(9))''')} AS cleaned FROM documents")
def doc_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirt = " \t\u00a0\r\n\u2028  \n\x0b\x0c"
    dirty = F.concat(F.lit(dirt), F.replace("text", F.lit(". "), F.lit(".\u00a0\r\n\n\n\x85 ")), F.lit("\t"))
    return table(spark, sf_dir, "documents").select("doc_id", text.cleaned(dirty).alias("cleaned"))


@query(f"""
    SELECT r_name, '| Nation | Key |' || chr(10) || '| --- | --- |' || chr(10) ||
           string_agg('| ' || {sql_cell("n_name || '|' || chr(10) || ' '")} || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def gfm_table_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    row = F.array(F.concat("n_name", F.lit("|\n ")), F.col("n_nationkey").cast("string"))
    keyed = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("rows"))
    rows = F.concat(F.array(F.array(F.lit("Nation"), F.lit("Key"))), F.transform("rows", lambda r: r["row"]))
    return keyed.select("r_name", gfm.table(rows).alias("markdown"))


@query(f"""
    WITH o AS (
      SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey,
             CASE o_orderkey % 4 WHEN 0 THEN [o_orderstatus, NULL, o_orderpriority || ' |x'] WHEN 1 THEN [o_orderstatus] WHEN 2 THEN ['', NULL] ELSE [' ', o_orderpriority] END AS cells
      FROM orders),
    f AS (
      SELECT o_custkey, CASE WHEN n = 1 AND o_custkey % 2 = 0 THEN [' ', chr(9)] ELSE cells END AS cells, n FROM o),
    k AS (
      SELECT o_custkey, n, list_transform(cells, lambda c: {sql_cell("c")}) AS cells FROM f WHERE len(list_filter(cells, lambda c: coalesce(c, '') <> '')) > 0),
    w AS (
      SELECT *, max(len(cells)) OVER (PARTITION BY o_custkey) AS width, row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS i FROM k),
    p AS (
      SELECT o_custkey, i, width, CASE WHEN i = 1 AND len(list_filter(cells, lambda c: c <> '')) = 0
                                       THEN list_transform(range(1, width + 1), lambda j: 'Column ' || j)
                                       ELSE list_resize(cells, width, '') END AS cells FROM w)
    SELECT a.o_custkey, coalesce(max(m.markdown), '') AS markdown
    FROM (SELECT DISTINCT o_custkey FROM orders) a LEFT JOIN (
      SELECT o_custkey, string_agg('| ' || array_to_string(cells, ' | ') || ' |' ||
             CASE WHEN i = 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(width), lambda j: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY i) AS markdown
      FROM p GROUP BY o_custkey) m USING (o_custkey) GROUP BY a.o_custkey""")
def gfm_ragged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    none = F.lit(None).cast("string")
    cells = F.when(key % 4 == 0, F.array(status, none, F.concat(priority, F.lit(" |x")))).when(key % 4 == 1, F.array(status)).when(key % 4 == 2, F.array(F.lit(""), none)).otherwise(F.array(F.lit(" "), priority))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", cells.alias("cells")))), lambda r: r["cells"]).alias("rows"))
    blank = F.array(F.lit(" "), F.lit("\t"))
    rows = rows.withColumn("rows", F.when(F.col("o_custkey") % 2 == 0, F.concat(F.array(blank), F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))))).otherwise(F.col("rows")))
    return rows.select("o_custkey", gfm.table(F.col("rows"), numbered_header=True).alias("markdown"))


#: Names that try the rules one after another.
NAME = "CASE p_partkey % 8 WHEN 0 THEN 'C:\\docs\\' || p_name || '.docx' WHEN 1 THEN '../..//' || p_name || '..pdf' WHEN 2 THEN 'con.pptx' WHEN 3 THEN '. .' WHEN 4 THEN 'cafe' || chr(769) || ' ' || p_name || '.tar.gz' WHEN 5 THEN repeat(p_name || ' ', 12) || '.pdf' WHEN 6 THEN 'a<b>:c?*' || p_name ELSE '.' || p_name END"
SQL_STEM = rf"""
    WITH n AS (SELECT p_partkey, {NAME} AS raw FROM part),
    b AS (SELECT *, regexp_replace(raw, '(?s)\A.*[/\\]', '') AS base FROM n),
    s AS (SELECT *, regexp_replace(nfc_normalize(regexp_replace(base, '(?s)\A(.+)\.[^.]+\z', '\1')), '{text.ILLEGAL}', '_', 'g') AS s0 FROM b),
    t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s0, '\.{{2,}}', '.', 'g'), '{W}+', ' ', 'g'), '\A(?:{W}|[.])+', ''), '(?:{W}|[.])+\z', '') AS s1 FROM s),
    u AS (SELECT *, regexp_replace(substring(s1, 1, 120), '[ .]+\z', '') AS s2 FROM t),
    v AS (SELECT *, CASE WHEN upper(s2) IN ({", ".join(f"'{d}'" for d in text.DEVICES)}) THEN s2 || '_file' WHEN s2 = '' THEN 'document' ELSE s2 END AS stem,
                 lower(regexp_extract(base, '(?s)\A.+(\.[^.]+)\z', 1)) AS ext FROM u)"""


@query(SQL_STEM + " SELECT p_partkey, raw, stem, ext FROM v")
def safe_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", F.expr(NAME.replace("\\", "\\\\").replace("chr(769)", "'\\u0301'")).alias("raw"))
    return named.select("p_partkey", "raw", text.safe_stem(F.col("raw")).alias("stem"), text.extension(F.col("raw")).alias("ext"))


#: Names with what browsers and others see differently: wide characters, a byte order mark, a next line.
WIDE = "chr(65279) || p_name || chr(133) || CASE p_partkey % 4 WHEN 0 THEN repeat('😀', (p_partkey % 70)::INT) || 'x. ' || repeat('é', 60) WHEN 1 THEN '..' || repeat('a. ', 50) WHEN 2 THEN '' ELSE ' .hidden' END || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.' ELSE '' END"


@query(rf"""
    WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN 'dir/aux.pdf' ELSE {WIDE} END AS raw FROM part),
    b AS (SELECT *, regexp_replace(raw, '(?s)\A.*[/\\]', '') AS base FROM n),
    s AS (SELECT *, regexp_replace(regexp_replace(nfc_normalize(regexp_replace(base, '(?s)\A(.+)\.[^.]*\z', '\1')), '{text.ILLEGAL}', '_', 'g'), '\.{{2,}}', '.', 'g') AS s0 FROM b),
    t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(s0, '{text.BROWSER}+', ' ', 'g'), '\A{text.BROWSER[:-1]}.]+', ''), '{text.BROWSER[:-1]}.]+\z', '') AS s1 FROM s),
    c AS (SELECT *, string_split(substring(s1, 1, 120), '') AS cs FROM t),
    w AS (SELECT *, list_transform(cs, lambda x: CASE WHEN octet_length(encode(x)) = 4 THEN 2 ELSE 1 END) AS us, length(s1) + length(regexp_replace(s1, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS units FROM c),
    u AS (SELECT *, CASE WHEN units > 120 THEN regexp_replace(array_to_string(list_filter(cs, lambda x, i: list_sum(us[1:i]) <= 120), ''), '{text.BROWSER[:-1]}.]+\z', '') ELSE s1 END AS s2 FROM w)
    SELECT p_partkey, CASE WHEN upper(s2) IN ({", ".join(f"'{d}'" for d in text.DEVICES)}) THEN s2 || '_file' WHEN s2 = '' THEN 'document' ELSE s2 END AS stem FROM u""")
def display_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as a browser shows them."""
    raw = F.expr(f"CASE WHEN p_partkey % 50 = 7 THEN 'dir/aux.pdf' ELSE {WIDE.replace('chr(65279)', chr(39) + chr(0xFEFF) + chr(39)).replace('chr(133)', chr(39) + chr(0x85) + chr(39)).replace('::INT', '')} END".replace("(p_partkey % 70)", "cast(p_partkey % 70 as int)"))
    return table(spark, sf_dir, "part").select("p_partkey", text.display_stem(raw).alias("stem"))


def sql_slug(x: str) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace({x}, '[^0-9A-Za-z_\\-. ]', '-', 'g'), '{W}+', '-', 'g'), '-+', '-', 'g')"
    return rf"substring(regexp_replace(regexp_replace({out}, '\A[-.]+', ''), '[-.]+\z', ''), 1, 80)"


@query(f"""{SQL_STEM},
    k AS (SELECT p_partkey, coalesce(nullif({sql_slug("stem")}, ''), 'document') AS slug, ext, 'job-' || p_partkey AS job, date '2024-01-01' + CAST(p_partkey % 400 AS INT) AS d FROM v)
    SELECT p_partkey, slug, 'jobs/' || strftime(d, '%Y-%m-%d') || '/' || job || '/source/' || slug || ext AS source,
           'jobs/' || strftime(d, '%Y-%m-%d') || '/' || job || '/result/' || slug || CASE WHEN p_partkey % 3 = 0 THEN '_markdown.zip' ELSE '.md' END AS result,
           'jobs/' || strftime(d, '%Y-%m-%d') || '/' || job || '/status.json' AS status,
           ext IN ('.docx', '.pptx', '.pdf') AS supported
    FROM k""")
def slug_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = safe_stem(spark, sf_dir).withColumn("slug", text.slug(F.col("stem")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 400).cast("int"))
    keys = paths.object_key(day, F.concat(F.lit("job-"), F.col("p_partkey").cast("string")), F.col("stem"), F.col("ext"), F.col("p_partkey") % 3 == 0)
    return named.select("p_partkey", "slug", keys.alias("k"), F.col("ext").isin(*ladder.SUPPORTED).alias("supported")).select("p_partkey", "slug", "k.source", "k.result", "k.status", "supported")


#: File names made from URLs, of every kind of extension.
FILE = "regexp_replace(url, '^.*/', '') || CASE page_id % 7 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.pptx' WHEN 2 THEN '.pdf' WHEN 3 THEN '.docm' WHEN 4 THEN '' WHEN 5 THEN '.pdf.exe' ELSE '/.pdf' END"


@query(rf"""
    WITH n AS (SELECT page_id, {FILE} AS name FROM pages),
    e AS (SELECT *, lower(regexp_extract(regexp_replace(name, '(?s)\A.*[/\\]', ''), '(?s)\A.+(\.[^.]+)\z', 1)) AS ext FROM n)
    SELECT page_id, name, ext, CASE WHEN ext IN ('.docx', '.pptx', '.pdf') THEN substring(ext, 2) END AS source_type,
           CASE WHEN ext IN ('.docx', '.pptx', '.pdf') THEN NULL ELSE 'UNSUPPORTED_FILE_TYPE' END AS error_code,
           CASE ext {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.MIME.items())} END AS mime FROM e""")
def extension_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    named = table(spark, sf_dir, "pages").select("page_id", F.expr(FILE).alias("name"))
    return named.select("page_id", "name", text.extension(name).alias("ext"), ladder.source_type(name).alias("source_type"), ladder.declared(name, F.lit(1)).alias("error_code"), paths.mime(text.extension(name)).alias("mime"))


#: Signed URLs of both forms, with escapes that are decoded once or twice.
URL = "CASE page_id % 4 WHEN 0 THEN 'https://store.example.com/jobs/2024-01-01/j%2B' || page_id || '/source/a+b%20c.pptx?sig=x' WHEN 1 THEN 'https://api.example.com/blob/?pathname=jobs%2F' || page_id || '%2Fresult%2Fa%2520b+c.zip&op=put' WHEN 2 THEN 'http://store.example.com//jobs/' || page_id || '/x.md' ELSE 'https://store.example.com' END"


@query(r"""
    WITH u AS (SELECT page_id, """ + URL + r""" AS url FROM pages),
    p AS (SELECT *, url_decode(replace(regexp_extract(url, '[?&]pathname=([^&#]*)', 1), '+', ' ')) AS q, url_decode(regexp_extract(url, '\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)) AS path FROM u)
    SELECT page_id, url, nullif(regexp_replace(CASE WHEN q <> '' THEN url_decode(q) ELSE path END, '\A/+', ''), '') AS pathname, url LIKE 'https://%' AS is_https FROM p""")
def url_pathname(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    made = table(spark, sf_dir, "pages").select("page_id", F.expr(URL).alias("url"))
    return made.select("page_id", "url", paths.url_pathname(url).alias("pathname"), url.startswith("https://").alias("is_https"))


#: Links and image tags of every kind, around a part's name.
MARKDOWN = "'Text ![a](C:\\out\\media\\image' || p_partkey || '.png) and ![b](https://x.example/media/y.png) ' || CASE p_partkey % 3 WHEN 0 THEN '<img src=\"/tmp/out/media/media/i' || p_size || '.jpg\" alt=\" ' || p_brand || ' \" style=\"width:1in\" />' WHEN 1 THEN '<IMG SRC=''./media/k.gif''>' ELSE '<img src=\"notmedia/z.png\">' END || ' ![c](other/' || p_size || '.png) end' || chr(10) || p_name"


@query(rf"""
    WITH m AS (SELECT p_partkey, {MARKDOWN} AS markdown, p_size, p_brand, p_name FROM part)
    SELECT p_partkey, 'Text ![a](media/image' || p_partkey || '.png) and ![b](https://x.example/media/y.png) ' ||
      CASE p_partkey % 3 WHEN 0 THEN '![' || p_brand || '](media/i' || p_size || '.jpg)' WHEN 1 THEN '![Image](media/k.gif)' ELSE '<img src="notmedia/z.png">' END ||
      ' ![c](other/' || p_size || '.png) end' || chr(10) || p_name AS markdown FROM m""")
def media_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select("p_partkey", F.expr(MARKDOWN.replace("\\", "\\\\").replace("''./media/k.gif''", "\\'./media/k.gif\\'")).alias("markdown"))
    return made.select("p_partkey", paths.portable_images(F.col("markdown")).alias("markdown"))


TAG = r"(?i)<(img|table|div|span|p|br|font|style|script|a)\b[^>]*>"


@query(rf"""
    WITH t AS (SELECT 'page' AS kind, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)
    SELECT kind, id, regexp_matches(body, '{TAG}') AS has_html, CAST(len(regexp_extract_all(body, '{TAG}')) AS INT) AS n_tags FROM t""")
def html_presence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return pages.unionByName(docs).select("kind", "id", F.col("body").rlike(TAG).alias("has_html"), F.size(F.regexp_extract_all("body", F.lit(TAG), F.lit(0))).alias("n_tags"))


@query("""
    SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0, 1)) WHEN b < 1073741824 THEN printf('%.1f MB', round(b / 1048576.0, 1)) ELSE printf('%.1f GB', round(b / 1073741824.0, 1)) END AS human
    FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1000 WHEN 2 THEN n_chars * 1000000 ELSE n_chars * 100000000 END AS b FROM documents)""")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars") * F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 1000).when(F.col("doc_id") % 4 == 2, 1000000).otherwise(100000000)
    return table(spark, sf_dir, "documents").select("doc_id", text.human_bytes(size).alias("human"))


@query(f"""
    WITH l AS (
      SELECT conv_id, turn, {sql_strip("text")} AS t, CASE WHEN conv_id % 2 = 0 THEN turn % 3 ELSE 0 END AS level FROM conversations)
    SELECT conv_id, CASE WHEN count(*) = 1 AND max(level) = 0 THEN max(t) ELSE string_agg(repeat('  ', CAST(level AS INT)) || '- ' || t, chr(10) ORDER BY turn) END AS block
    FROM l WHERE t <> '' GROUP BY conv_id""")
def text_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations")
    level = F.when(F.col("conv_id") % 2 == 0, F.col("turn") % 3).otherwise(0).cast("int")
    frames = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", level.alias("level"), "text"))).alias("p"))
    return frames.select("conv_id", gfm.text_frame(F.col("p")).alias("block"))


@query(rf"""
    WITH d AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '.PNG' WHEN 1 THEN '  A ' || chr(9) || p_name || ' ' WHEN 2 THEN 'Größe (1).jpeg' ELSE NULL END AS described FROM part),
    s AS (SELECT *, {sql_squeezed("coalesce(described, '')")} AS t FROM d)
    SELECT p_partkey, CASE WHEN t = '' OR regexp_matches(t, '(?i)\A[\p{{L}}\p{{N}}_ \-.()]+\.({text.IMAGE_SUFFIXES})\z') THEN 'Slide ' || (p_partkey % 9 + 1) || ' image' ELSE t END AS alt FROM s""")
def alt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    described = F.when(key % 4 == 0, F.concat("p_name", F.lit(".PNG"))).when(key % 4 == 1, F.concat(F.lit("  A \t"), F.col("p_name"), F.lit(" "))).when(key % 4 == 2, "Größe (1).jpeg")
    otherwise = F.concat(F.lit("Slide "), (key % 9 + 1).cast("string"), F.lit(" image"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alt_text(described, otherwise).alias("alt"))
