from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from folioflow.llm import importance

from llm_data import documents, odd_texts, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def counted(text: str | None, longest: int, buckets: int) -> tuple[int, Counter]:
    found = words(text)
    grams = [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]
    return len(grams), Counter(zlib.crc32(g.encode()) % buckets for g in grams)


def brute(docs: list[tuple], target: list[str | None], s: importance.Resampling) -> Counter:
    raw, want = Counter(), Counter()
    for _, t in docs:
        raw += counted(t, s.longest, s.buckets)[1]
    for t in target:
        want += counted(t, s.longest, s.buckets)[1]
    S, T = raw.total(), want.total()
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (S + s.buckets) / ((raw[b] + 1) * (T + s.buckets))))
    rows = []
    for i, t in docs:
        n, own = counted(t, s.longest, s.buckets)
        weight = sum(gain(b) * k for b, k in own.items())
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t)) >= s.least_words])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    out = Counter((*r[:4], None) for r in rows if not r[4])
    drawn = len(fit) * s.percent // 100
    return out + Counter((*r[:4], k if k <= drawn else None) for k, r in enumerate(fit, 1))


def run(spark, docs: list[tuple], target: list[str | None], s: importance.Resampling) -> Counter:
    df = documents(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(3)
    wanted = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, bucket string")
    out = importance.resample(df, wanted, s)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return Counter(map(tuple, out.collect()))


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, longest):
    rng = random.Random(longest)
    texts = odd_texts() + [prose(rng, rng.randint(0, 60)) for _ in range(80)] + ["Ünï Çode ÄB Ab aB\x85x y 漢字 😀, I'm A-Z 0x1F"] * 3 + [" ".join(["the"] * 700)]
    settings = importance.Resampling(longest=longest, buckets=500, percent=30, least_words=10)
    target = [prose(rng, 30) for _ in range(10)] + [None, ""]
    docs = list(enumerate(texts))
    assert run(spark, docs, target, settings) == brute(docs, target, settings)


def test_null_ids_repeated_rows_and_ties(spark):
    rng = random.Random(9)
    text = prose(rng, 30)
    docs = [(None, text), (None, text), (3, text), (3, text), (3, prose(rng, 25)), (4, text), (5, None)] + [(7, text)] * 40
    settings = importance.Resampling(percent=40)
    assert run(spark, docs, [text, "other"], settings) == brute(docs, [text, "other"], settings)


def test_empty_tables(spark):
    settings = importance.Resampling(percent=50, least_words=1)
    assert run(spark, [], ["a"], settings) == Counter()
    docs = [(1, "a b"), (2, "a"), (3, "")]
    assert run(spark, docs, [], settings) == brute(docs, [], settings)


def test_a_dictionary_that_starts_anew_gives_the_same_counts(monkeypatch):
    rng = random.Random(5)
    texts = [[w.encode() for w in prose(rng, 50).split()] for _ in range(30)]
    usual = importance.Counter(2, 97)
    found = [usual(texts[k : k + 5]) for k in range(0, 30, 5)]
    monkeypatch.setattr(importance, "WORDS", 20)
    small = importance.Counter(2, 97)
    for k, want in zip(range(0, 30, 5), found, strict=True):
        assert all((a == b).all() for a, b in zip(small(texts[k : k + 5]), want, strict=True))


def test_ranks_follow_the_order_over_partitions(spark):
    rows = [(i, 1, 0, rank, True) for i, rank in enumerate(range(1000))]
    dealt = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, fit boolean").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id")
    from pyspark.sql import functions as F

    out = importance.ranked(dealt.withColumn("at", F.monotonically_increasing_id()), 25).collect()
    assert all(r["rank"] == (r["doc_id"] + 1 if r["doc_id"] < 250 else None) for r in out)
