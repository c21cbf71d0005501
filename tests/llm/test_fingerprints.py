from __future__ import annotations

import base64
import random
import re
import struct

import duckdb
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import fingerprints as f
from folioflow.llm.queries import op3_fingerprints

from llm_data import documents, odd_texts, prose


def test_next_and_edited_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(f, "BUCKET_ROWS", 3)  # many buckets
    rng = random.Random(9)
    texts = odd_texts() + [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    ids = rng.sample(range(-1000, 10**12), len(texts))
    got = {r["doc_id"]: r for r in f.fingerprints(documents(spark, texts, ids)).collect()}
    order = sorted(ids)
    by_id = {i: t or "" for i, t in zip(ids, texts, strict=True)}
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        text, after = by_id[i], by_id[following]
        half = len(text) // 2
        assert got[i]["next_text"] == after
        assert got[i]["edited"] == text[: len(text) - half] + after[:half]
        assert got[i]["sketch"] == sorted(set(got[i]["sketch"]))
        assert got[i]["next_sketch"] == got[following]["sketch"]


def test_few_rows_ties_and_nulls(spark):
    assert f.fingerprints(documents(spark, [])).count() == 0
    assert f.fingerprints(documents(spark, ["alone here"])).first()["next_text"] == "alone here"
    got = f.fingerprints(documents(spark, ["b", "a", "c", "a"], [1, 1, None, 1])).select("text", "next_text").collect()
    assert sorted(tuple(r) for r in got) == [("a", "a"), ("a", "b"), ("b", "c"), ("c", "a")]


def test_the_sketch_keeps_its_share_and_estimates(spark):
    rng = random.Random(10)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    whole, part, other = " ".join(words), " ".join(words[1000:3000]), " ".join(f"v{i}" for i in range(3000))
    df = spark.createDataFrame([(whole, part, other)], "a string, b string, c string").select(*[f.sketch(F.col(c)).alias(c) for c in "abc"])
    r = df.select(F.size("a").alias("n"), f.containment(F.col("b"), F.col("a")).alias("inside"), f.containment(F.col("a"), F.col("b")).alias("holds"), f.containment(F.col("c"), F.col("a")).alias("none"), f.likeness(F.col("a"), F.col("a")).alias("same"), (f.merged(F.col("a"), F.col("b")) == F.col("a")).alias("merges")).first()
    assert abs(r["n"] / 5996 - f.SHARE) < 0.006
    assert r["inside"] == 1 and abs(r["holds"] - 1 / 3) < 0.2 and r["none"] == 0 and r["same"] == 1 and r["merges"]


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def brute_all(text: str) -> list[int]:
    """Every shingle's hash, by another library's hash of bytes: a word by its bytes, a shingle by its words' hashes one after another."""
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    found = set()
    for i in range(len(h) - f.WORDS + 1):
        seed = 42
        for x in h[i : i + f.WORDS]:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
        found.add(seed >> 32)
    if 0 < len(h) < f.WORDS:
        found = {xxhash.xxh64_intdigest(" ".join(map(str, h)).encode(), 42) >> 32}
    return sorted(found)


def kept(hashes: list[int]) -> list[int]:
    return [x for i, x in enumerate(hashes) if x < 2**32 * f.SHARE or i < f.FLOOR]


def brute_sketch(text: str) -> list[int]:
    return kept(brute_all(text))


def brute_likeness(a: list[int], b: list[int]) -> float:
    most = min(2**32 if len(x) < f.FLOOR else max(2**32 * f.SHARE - 1, x[-1]) for x in (a, b))
    a, b = ({x for x in s if x <= most} for s in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_and_likeness_equal_brute_force(spark):
    rng = random.Random(12)
    texts = [t or "" for t in odd_texts()] + [prose(rng, rng.randint(0, 14)) for _ in range(150)]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(200)] + [(t, " ".join(t.split()[:-1])) for t in texts]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", f.sketch(F.col("a")).alias("a"), f.sketch(F.col("b")).alias("b"))
    got = df.select("a", "b", f.likeness(F.col("a"), F.col("b"))).orderBy("i").collect()
    for (a, b), row in zip(pairs, got, strict=True):
        x, y = brute_sketch(a), brute_sketch(b)
        assert (row[0], row[1]) == (x, y)
        assert abs(row[2] - brute_likeness(x, y)) < 1e-12
        assert bool(x) == bool(a.split())
        assert len(x) == min(f.FLOOR, len(brute_all(a))) or all(h < 2**32 * f.SHARE for h in x)


def test_likeness_of_short_texts(spark):
    df = spark.createDataFrame([("a b", "a b"), ("a b", "c d"), ("", ""), ("", "a")], "a string, b string")
    got = [r[0] for r in df.select(f.likeness(f.sketch(F.col("a")), f.sketch(F.col("b")))).collect()]
    assert got == [1.0, 0.0, 1.0, 0.0]


def test_merging_sketches_gives_the_sketch_of_both(spark):
    rng = random.Random(13)
    pairs = [(prose(rng, rng.choice([0, 3, 9, 40, 90, 4000])), prose(rng, rng.choice([0, 3, 9, 40, 90, 4000]))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", f.merged(f.sketch(F.col("a")), f.sketch(F.col("b")))).collect()
    for a, b, both in got:
        assert both == kept(sorted({*brute_all(a), *brute_all(b)}))


def test_containment_between_very_unequal_texts(spark):
    rng = random.Random(14)
    words = [f"w{rng.randrange(10**7)}" for _ in range(40_000)]
    rows = []
    for n, share in ((20, 1.0), (20, 0.0), (300, 1.0), (300, 0.0), (20_000, 0.5), (4, 1.0)):
        at = rng.randrange(len(words) - n)
        inner = words[at : at + int(n * share)] + [f"v{rng.randrange(10**7)}" for _ in range(n - int(n * share))]
        rows.append((" ".join(inner), " ".join(words), share))
    df = spark.createDataFrame(rows, "a string, b string, share double").select("share", f.containment(f.sketch(F.col("a")), f.sketch(F.col("b"))).alias("c"))
    for r in df.collect():
        assert r["c"] is None or abs(r["c"] - r["share"]) < 0.12


def test_the_query_equals_sql_and_its_fingerprints(spark, sf_dir):
    """Lengths and edited texts against SQL; likeness against the fingerprints as they are written."""
    got = {r["doc_id"]: r for r in op3_fingerprints(spark, sf_dir).collect()}
    sql = f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM read_parquet('{sf_dir}/documents.parquet')),
        n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following, length(text) // 2 AS half FROM d)
        SELECT doc_id, length(text) AS n_chars, sha256(substring(text, 1, length(text) - half) || substring(following, 1, half)) AS edited_sha256 FROM n ORDER BY doc_id"""
    rows = duckdb.sql(sql).fetchall()
    hashes = lambda written: [x[0] for x in struct.iter_unpack(">I", base64.b64decode(written))]
    assert sum(len(r["fingerprint"]) for r in got.values()) < 0.1 * sum(r["n_chars"] for r in got.values())
    for i, (doc, n, edited) in enumerate(rows):
        r, following = got[doc], got[rows[(i + 1) % len(rows)][0]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, edited)
        assert abs(r["near_edited"] - brute_likeness(hashes(r["fingerprint"]), hashes(r["edited_fingerprint"]))) < 1e-12
        assert abs(r["near_next"] - brute_likeness(hashes(r["fingerprint"]), hashes(following["fingerprint"]))) < 1e-12
        assert r["fingerprint"] or not n
    assert len(got) == len(rows)


def test_short_texts_have_fingerprints_near_their_exact_similarity(spark):
    rng = random.Random(11)
    pairs = []
    for _ in range(200):
        a = [f"w{rng.randrange(10**6)}" for _ in range(21)]  # 17 shingles
        pairs.append((" ".join(a), " ".join([*a[: rng.randint(8, 20)], *(f"v{rng.randrange(10**6)}" for _ in range(5))])))
    sets = [[{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in pair] for pair in pairs]
    exact = [len(a & b) / len(a | b) for a, b in sets]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").withColumn("s", f.sketch(F.col("a")))
    got = df.select(F.size("s"), f.likeness(F.col("s"), f.sketch(F.col("b")))).orderBy("i").collect()
    assert all(r[0] > 0 for r in got)
    assert sum(abs(r[1] - x) for r, x in zip(got, exact, strict=True)) / len(exact) < 0.1


def test_only_built_in_functions_run(spark):
    plan = f.fingerprints(documents(spark, ["x", "y"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
