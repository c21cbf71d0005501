from __future__ import annotations

import random
import zlib
from dataclasses import replace

import numpy as np
import pytest
from llm_data import documents, odd_texts, prose
from pyspark.sql import functions as F

from folioflow.llm import toxicity as t

SMALL = replace(t.Settings(), epochs=4)
INSULTS = ("snarkle", "grumbuck", "vilewort")


def labelled(n: int, seed: int) -> tuple[list[str], list[int]]:
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 250)).split()
        if i % 3 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    return texts, toxic


@pytest.fixture(scope="module")
def net():
    return t.fit(*labelled(600, 1), SMALL)


def test_gradients_equal_differences():
    s = t.Settings(window=5, stride=3, states=3, word_size=2, char_size=2, buckets=16)
    net = t.Network({"a": 1, "b": 2}, s)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    grams = t.Grams(np.array([1, 2, 3, 4, 5, 6]), np.array([0, 2, 3, 6]))
    index, mask = np.array([[0, 1, 2, 1, 0], [2, 2, 1, 0, 0]]), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], bool)
    args = (net, np.array([0, 1, 2]), grams, index, mask, np.array([1.0, 0.0]), np.array([1.0, 2.0]))
    _, g = t.gradients(*args)
    for k, w in net.w.items():
        flat = w.reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            kept = flat[i]
            flat[i] = kept + 1e-3
            up, _ = t.gradients(*args)
            flat[i] = kept - 1e-3
            down, _ = t.gradients(*args)
            flat[i] = kept
            assert abs((up - down) / 2e-3 - g[k].reshape(-1)[i]) < 1e-5


def test_both_ways_through_the_network_agree(net):
    """The loss that training computes is the one that the scoring path's logits give."""
    scorer = t.Scorer(net)
    docs = [t.words_of(x or "") for x in odd_texts()]
    _, index, mask = t.windows(scorer.ids(docs), net.s)
    names = list(scorer.place)
    target = (np.arange(len(index)) % 2).astype(np.float32)
    known = np.array([net.vocabulary.get(x, 0) for x in names])
    loss, _ = t.gradients(net, known, t.Grams.of(names, net.s.buckets), index, mask, target, np.ones(len(index), dtype=np.float32))
    p = 1 / (1 + np.exp(-net.logits(scorer.table, index, mask)))
    assert abs(loss + (target * np.log(p + 1e-7) + (1 - target) * np.log(1 - p + 1e-7)).mean()) < 1e-4 * loss


def test_sums_of_rows():
    index, values = np.array([3, 1, 3, 0, 3]), np.arange(10.0).reshape(5, 2)
    want = np.zeros((5, 2))
    np.add.at(want, index, values)
    assert (t.summed(index, values, 5) == want).all()


def test_windows_cover_every_word():
    s = t.Settings(window=8, stride=5)
    for n in range(0, 60):
        owner, index, mask = t.windows([np.arange(n, dtype=np.int32), np.arange(3, dtype=np.int32)], s)
        assert set(index[(owner == 0)[:, None] & mask]) == set(range(n))
        assert (owner == 0).sum() >= 1 and mask[owner == 1].sum() == 3


def test_held_out_accuracy(net):
    texts, toxic = labelled(300, 2)
    score = t.Scorer(net)(texts)
    assert ((score >= 0.3) == np.array(toxic)).mean() > 0.97
    clean = prose(random.Random(5), 400)
    buried = clean + " " + INSULTS[0] + " " + INSULTS[1] + " " + prose(random.Random(6), 3000)
    assert t.Scorer(net)([buried])[0] > 0.3 > t.Scorer(net)([clean])[0]  # one window of many decides


def test_texts_that_share_an_opening_all_count(monkeypatch):
    opening = "all of these documents begin with one common line "
    texts, toxic = labelled(30, 3)
    read = []
    monkeypatch.setattr(t, "windows", lambda ids, s, f=t.windows: read.append(len(ids)) or f(ids, s))
    t.fit([opening + x for x in texts] + [opening + texts[0].upper()], [*toxic, 0], replace(SMALL, epochs=1, first_epochs=0, first_steps=0, least_steps=1))
    assert read == [30]  # the last is a copy of the first


def test_scores_do_not_depend_on_batches(net):
    texts = [x or "" for x in odd_texts()]
    together = t.Scorer(net)(texts)
    alone = np.array([t.Scorer(net, most=10)([x])[0] for x in texts])
    assert np.abs(together - alone).max() < 1e-4


def test_the_operator(spark, net):
    texts = odd_texts() + [f"you {INSULTS[0]} you {INSULTS[1]} {INSULTS[2]}"]
    df = documents(spark, texts)
    got = {r["doc_id"]: r["score"] for r in t.score(df, net).collect()}
    assert len(got) == len(texts) and all(0 <= v <= 1 for v in got.values())
    assert got[0] == got[1] and got[8] == got[9] and got[len(texts) - 1] > 0.3
    kept = t.reject(df, net, 0.3)
    assert kept.schema == df.schema and {r["doc_id"] for r in kept.collect()} == {i for i, v in got.items() if v < 0.3}
    assert t.score(documents(spark, []), net).count() == 0
    assert t.score(documents(spark, ["a", "a"], [None, None]), net).count() == 2


def test_training_rows_leave_out_what_is_held_out(spark):
    docs = documents(spark, [f"text {i}" for i in range(60)])
    labels = spark.createDataFrame([(i, None if i == 7 else i % 2) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    used = {int(r["text"].split()[1]) for r in t.training_rows(docs, labels, t.Settings()).collect()}
    assert used == {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2 and i != 7}
    assert {r["doc_id"] for r in docs.where(t.held_out(F.col("doc_id"))).collect()} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2}
    few = t.Settings(sample_toxic=3, sample_clean=4)
    assert t.training_rows(docs, labels, few).count() == 7


def test_without_labels_the_score_is_the_base_rate(spark):
    df = documents(spark, ["a b", "c"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.train(df, none) == 0.0
    assert [r["score"] for r in t.score(df, 0.0).collect()] == [0.0, 0.0]
    assert t.fit(["a", "b"], [1, 1], t.Settings()) == 1.0


def test_the_query_on_held_out_rows(spark):
    """Precision and recall at the threshold, of the registered query, over the labelled rows that training never sees."""
    import os

    from folioflow.llm.queries import op1_toxicity

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no tables of this size")
    rows = op1_toxicity(spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    both = rows.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in both.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n[0, 1]) >= 0.85
    assert n[1, 1] / (n[1, 1] + n[1, 0]) >= 0.9
