from __future__ import annotations

import os

import pytest

from folioflow.sources import samples as s
from folioflow.sources.table_functions import register
from folioflow.streaming.listing import Cursor, listing_stream


def files(root, names: list[str]) -> None:
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)


def test_pages_and_cursor(tmp_path):
    files(tmp_path, [f"jobs/{i:04d}" for i in range(1000)])
    cursor = Cursor(str(tmp_path), 250, 500, None)
    rows, offset = cursor.read(cursor.initialOffset())
    first = [r[0] for r in rows]
    assert len(first) == 500 and offset == {"after": first[-1]} and first == sorted(first)
    assert [r[0] for r in cursor.readBetweenOffsets({"after": ""}, offset)] == first
    rows, end = cursor.read(offset)
    assert [r[0] for r in rows] == [f"jobs/{i:04d}" for i in range(500, 1000)]
    rows, same = cursor.read(end)
    assert list(rows) == [] and same == end


def test_a_batch_ends_after_the_page_in_which_enough_are_old(tmp_path):
    files(tmp_path, [f"{i:03d}" for i in range(100)])
    for i in range(100):
        os.utime(tmp_path / f"{i:03d}", (1000, 1000 if i % 3 == 0 else 5000))
    rows, offset = Cursor(str(tmp_path), 10, 8, 2_000_000_000).read({"after": ""})
    assert len(list(rows)) == 30 and offset == {"after": "029"}  # 4, 7, then 10 are old


def test_a_stream_that_is_started_anew_repeats_no_key(spark, tmp_path):
    root, seen = tmp_path / "in", []
    files(root, [f"{i:02d}" for i in range(30)])

    def run() -> None:
        query = listing_stream(spark, str(root), page=4, most=8).writeStream.foreachBatch(lambda b, e: seen.append([r["key"] for r in b.collect()])).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    assert [len(b) for b in seen if b] == [8, 8, 8, 6]
    files(root, ["30", "31", "00a"])  # a key behind the cursor's back is not told
    run()
    assert [k for b in seen for k in b] == [f"{i:02d}" for i in range(32)]


def test_documents_in_sql(spark):
    register(spark)
    rows = [("a", bytearray(s.pptx([s.title("T") + s.box(s.paragraph("x") + s.paragraph("y", 1)) + s.picture("m0", top=9)], {"i.png": s.png(1)})), ".PPTX"), ("b", bytearray(b"no pdf"), "pdf"), ("c", None, "pdf"), ("d", bytearray(b""), "odt"), ("e", bytearray(s.pdf(["x"], encrypted=True)), "pdf")]
    spark.createDataFrame(rows, "name string, content binary, type string").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT name, seq, kind, text, paragraphs, error_code FROM some_files, LATERAL document_items(content, type) ORDER BY name, seq").collect()
    assert [(r["name"], r["kind"], r["error_code"]) for r in got] == [("a", "slide", None), ("a", "frame", None), ("b", None, "INVALID_FILE_FORMAT"), ("c", None, "DOWNLOAD_FAILED"), ("d", None, "UNSUPPORTED_FILE_TYPE"), ("e", None, "PASSWORD_PROTECTED")]
    assert [tuple(p) for p in got[1]["paragraphs"]] == [(0, "x"), (1, "y")]
    media = spark.sql("SELECT i.kind, i.content, i.digest FROM some_files f, LATERAL document_items(f.content, f.type, true) i WHERE i.kind = 'image'").collect()
    assert [bytes(r["content"]) for r in media] == [s.png(1)] and media[0]["digest"]
    for wrong in ("document_items(name, type)", "document_items(content, 1)", "document_items(content, type, name = 'a')"):
        with pytest.raises(Exception, match="argument"):
            spark.sql(f"SELECT * FROM some_files, LATERAL {wrong}").collect()
