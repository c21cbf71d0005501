from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioflow.config import Limits, from_env
from folioflow.functions import tokens
from folioflow.operators import ladder, lifecycle, media, outcome
from folioflow.sources import files
from folioflow.streaming import jobs

SECRET = b"s" * 32


def test_settings_come_from_the_environment():
    got = from_env({"FOLIOFLOW_MAX_MEMBERS": "7", "FOLIOFLOW_TABLES": "off", "FOLIOFLOW_DEADLINE": "soon"})
    assert (got.max_members, got.tables, got.deadline) == (7, False, 690)


def test_archive_rules_in_order(spark):
    rows = [(1, 10, 10, False), (10_001, 10, 10, False), (1, 10, 10, True), (1, 351 << 20, 300 << 20, False), (1, 5 << 20, 1 << 10, False), (1, 3 << 20, 1, False), (1, 5 << 20, 0, False)]
    df = spark.createDataFrame(rows, "m long, e long, c long, u boolean")
    codes = [r[0] for r in df.select(ladder.archive(F.col("m"), F.col("e"), F.col("c"), F.col("u"))).collect()]
    assert codes == [None, "OFFICE_ARCHIVE_UNSAFE", "OFFICE_ARCHIVE_UNSAFE", "DOCUMENT_EXPANDS_TOO_LARGE", "OFFICE_ARCHIVE_UNSAFE", None, None]


def test_unsafe_members(evaluate):
    names = ["a/b.xml", "/etc/x", "C:/x", "a/../b", "a..b/c", "..\\x", "../dir/"]
    assert evaluate(ladder.unsafe_member, names) == [False, True, True, True, False, True, False]


def test_tokens_hold_and_fail(spark):
    claims = {"exp": F.lit(1000).cast("long"), "filename": F.lit("Übersicht.pdf"), "job_id": F.lit("j"), "result_path": F.lit("r"), "source_path": F.lit("s"), "source_size": F.lit(5).cast("long")}
    token = spark.range(1).select(tokens.mint(claims, SECRET)).first()[0]
    cases = [(token, 1060, SECRET), (token, 1061, SECRET), (token, 0, b"t" * 32), (token[:-2] + "xx", 0, SECRET), ("nothing", 0, SECRET), (None, 0, SECRET)]
    codes = [spark.createDataFrame([(t,)], "t string").select(tokens.verify(F.col("t"), F.lit(now), key)["code"]).first()[0] for t, now, key in cases]
    assert codes == [None, "JOB_TOKEN_EXPIRED", "JOB_TOKEN_INVALID", "JOB_TOKEN_INVALID", "JOB_TOKEN_INVALID", "JOB_TOKEN_INVALID"]
    with pytest.raises(ValueError):
        tokens.signer(b"short")


def test_a_settled_job_ignores_what_comes_later(spark):
    rows = [("a", 1, "accepted"), ("a", 3, "complete"), ("a", 5, "uploading"), ("b", 1, "accepted"), ("b", 2, "converting"), ("b", 2, "downloading"), ("c", 1, "failed")]
    df = spark.createDataFrame(rows, "job_id string, t long, stage string").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["job_id"]: (r["stage"], r["progress"], r["done"], r["ok"]) for r in lifecycle.latest_status(df).collect()}
    assert got == {"a": ("complete", 100, True, True), "b": ("converting", 35, False, True), "c": ("failed", 100, True, False)}
    assert lifecycle.before_settled(df).where("job_id = 'a'").count() == 2


def test_a_sweep_stops_after_the_page_that_reaches_its_limit(spark):
    rows = [(f"jobs/d/{i:04d}/{'source' if i % 2 else 'other'}/x", 0) for i in range(100)]
    df = spark.createDataFrame(rows, "path string, t long").withColumn("uploaded_at", F.timestamp_seconds("t"))
    now = F.timestamp_seconds(F.lit(60 * 60))
    assert lifecycle.expired(df, now).count() == 50
    assert lifecycle.expired(df, F.timestamp_seconds(F.lit(60 * 60 - 1))).count() == 0
    # the 12th expired object is the 24th of all, on the third page of 10
    assert lifecycle.paged_deletions(df, now, page=10, most=12).count() == 15
    assert lifecycle.paged_deletions(df, now, page=10, most=500).count() == 50


def test_a_ledger_refuses_and_floors(spark):
    rows = [("p", i, a) for i, a in enumerate([5, 5, 1, -9, 6])] + [(None, 0, 7), (None, 1, None), (None, 2, 6), ("q", 0, -1)]
    df = spark.createDataFrame(rows, "pool string, n int, amount long").repartition(3)
    got = {(r["pool"], r["n"]): (r["reserved"], r["fits"]) for r in lifecycle.admission_replay(df, 6, "n").collect()}
    assert [got["p", i] for i in range(5)] == [(5, True), (5, False), (6, True), (0, True), (6, True)]
    assert [got[None, i] for i in range(3)] == [(0, False), (0, True), (6, True)] and got["q", 0] == (0, True)
    assert lifecycle.admission_replay(df.limit(0), 6, "n").count() == 0


def test_names_in_use_are_not_given_again(spark):
    wanted = ["a.png", "a.png", "a-2.png", "a.png", "a-2.png", "b", "b", None, "c.d.png", "c.d.png"]
    df = spark.createDataFrame([("d", i, w, "old") for i, w in enumerate(wanted)] + [("e", 0, "a.png", "old")], "doc string, seq int, wanted string, name string")
    got = {(r["doc"], r["seq"]): r["name"] for r in media.without_collisions(df, "doc", "wanted", "seq").collect()}
    assert [got["d", i] for i in range(len(wanted))] == ["a.png", "a-2.png", "a-2-2.png", "a-3.png", "a-2-3.png", "b", "-2.b", None, "c.d.png", "c.d-2.png"]
    assert got["e", 0] == "a.png"


def test_contact_is_lost_after_failures_in_a_row(spark):
    rows = [("a", i, i == 4) for i in range(13)] + [("b", i, None if i % 2 else False) for i in range(16)] + [("c", i, i % 7 == 0) for i in range(50)]
    got = {r["job_id"]: r["ts"] for r in lifecycle.lost_contact(spark.createDataFrame(rows, "job_id string, ts int, ok boolean")).collect()}
    assert got == {"a": 12, "b": 14}


def test_tables_within_their_time(spark):
    seconds = [1.0, 6.0, 2.0, 2.0, 9.0, 1.0]
    df = spark.createDataFrame([("d", i, x, 6) for i, x in enumerate(seconds)] + [("e", i, 1.0, 9) for i in range(2)], "doc string, page int, seconds double, pages int")
    got = outcome.table_budget(df, "doc", "page", Limits(table_page_seconds=5, deadline=10, table_reserve_seconds=0, max_table_pages=8))
    assert [r["tables"] for r in got.orderBy("doc", "page").collect()] == ["kept", "slow", "kept", "over", "stopped", "stopped", "pages", "pages"]


def test_stages_in_and_out_of_order(spark):
    rows = [("a", 1, "accepted"), ("a", 2, "converting"), ("a", 3, "downloading"), ("a", 4, "complete"), ("a", 5, "uploading")]
    df = spark.createDataFrame([(j, t, t, s) for j, t, s in rows], "job_id string, event_id int, ts int, stage string")
    assert [r["allowed"] for r in lifecycle.out_of_order(df).orderBy("ts").collect()] == [True, True, False, True, False]


def test_statuses_are_published_or_the_failure_is_told(spark, tmp_path):
    df = spark.createDataFrame([("a", "accepted")], "job_id string, stage string")
    assert jobs.publish(df, str(tmp_path / "s")) and jobs.publish(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    (tmp_path / "file").write_text("x")
    assert not jobs.publish(df, str(tmp_path / "file" / "below"))


def test_repeated_jobs_of_a_stream_count_once(spark, tmp_path):
    rows = [("a", 0), ("a", 10), ("b", 20), ("a", 30)]
    spark.createDataFrame(rows, "job_id string, t long").select("job_id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, ts timestamp").parquet(str(tmp_path / "in"))
    out = jobs.run_to_end(jobs.once_per_job(stream, "job_id", "ts"), str(tmp_path / "work"), mode="append")
    assert sorted(r["job_id"] for r in out.collect()) == ["a", "b"]


def test_uploads_are_checked(spark, tmp_path):
    root = tmp_path / "out"
    root.mkdir()
    (root / "taken").write_text("a file where a folder is wanted")
    df = spark.createDataFrame([("x/a.md", bytearray(b"abc")), ("b.md", bytearray(b"")), ("taken/c.md", bytearray(b"d")), ("e.md", None)], "key string, content binary")
    got = {r["key"]: (r["n_bytes"], r["error_code"]) for r in files.uploaded(df, str(root)).collect()}
    assert got == {"x/a.md": (3, None), "b.md": (0, None), "taken/c.md": (1, "RESULT_UPLOAD_FAILED"), "e.md": (None, "RESULT_UPLOAD_FAILED")}
    assert (root / "x/a.md").read_bytes() == b"abc" and not (root / "e.md").exists()
    with pytest.raises(OSError):
        files.write_files(df, str(root))
    assert files.write_files(df.limit(2), str(root)) == 2


def test_media_budget_and_names(spark):
    rows = [("d", 1, 1, 1, "x", 60), ("d", 2, 1, 2, "x", 60), ("d", 3, 2, 1, "y", 30), ("d", 4, 3, 1, "z", 20)]
    refs = spark.createDataFrame(rows, "doc_id string, seq long, part_no int, position int, digest string, n_bytes long").withColumn("extension", F.lit(".png"))
    names = {(r["seq"], r["name"]) for r in media.named(refs).collect()}
    assert names == {(1, "slide-001-image-001.png"), (2, "slide-001-image-001.png"), (3, "slide-002-image-002.png"), (4, "slide-003-image-003.png")}
    assert {r["name"] for r in media.named(refs, per_part=True, prefix="page").collect()} == {"page-001-image-001.png", "page-002-image-001.png", "page-003-image-001.png"}
    b = media.within_budget(media.first_occurrences(refs), 100).first()
    assert (b["media_count"], b["media_bytes"], b["error_code"]) == (2, 90, "DOCUMENT_EXPANDS_TOO_LARGE")


def test_archives_are_ordered_and_repeatable(spark):
    files = [("b.md", b"1"), ("a/é.png", b"2"), ("a/z.png", b"3")]
    assert outcome.archive(files) == outcome.archive(files[::-1])
    trees = spark.createDataFrame([("d", "stem", [("x.md", bytearray(b"x" * 50))]), ("e", "stem", [])], "doc_id string, stem string, files array<struct<path:string,content:binary>>")
    assert {r["doc_id"]: r["error_code"] for r in outcome.packaged(trees).collect()} == {"d": None, "e": "CONVERSION_FAILED"}
    assert outcome.packaged(trees, limits=Limits(max_result_bytes=10)).where("doc_id = 'd'").first()["error_code"] == "RESULT_TOO_LARGE"
