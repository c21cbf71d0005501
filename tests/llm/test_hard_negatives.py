from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, row string, id long, ints string, anchor_id int"


def table(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


def brute(rows: list[tuple], is_anchor, s: hn.Mining) -> Counter:
    usable = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(s.scale * x) for x in v] for _, v, _ in usable]
    out: Counter = Counter()
    for a, (a_id, _, a_label) in enumerate(usable):
        if not is_anchor(a_id):
            continue
        scored = sorted((-sum(x * y for x, y in zip(ints[a], v, strict=False)), usable[k][0], k) for k, v in enumerate(ints) if k != a)
        for p_score, p_id, _ in [x for x in scored if usable[x[2]][2] == a_label][: s.positives]:
            fit = [x for x in scored if usable[x[2]][2] != a_label and s.low * -p_score <= 100 * -x[0] <= s.high * -p_score]
            for rank, (n_score, n_id, _) in enumerate(fit[: s.negatives], 1):
                out[(a_id, p_id, rank, n_id, -p_score, -n_score)] += 1
    return out


def mined(spark, rows: list[tuple], every: int, s: hn.Mining = hn.Mining(), parts: int = 3) -> Counter:
    return Counter(map(tuple, hn.mine(table(spark, rows).repartition(parts), F.col("vec_id") % every == 0, s).collect()))


def vectors(seed: int, n: int, dim: int, labels: int, spread: float) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = (centres[label] + spread * rng.normal(size=dim)) * np.geomspace(1, 0.05, dim)
        out.append((i, [float(x) for x in v], label))
    return out


@pytest.mark.parametrize(("dim", "labels", "spread"), [(12, 3, 0.5), (12, 5, 2.0), (1, 2, 1.0), (40, 4, 1.0)])
def test_against_brute_force(spark, dim, labels, spread):
    rows = vectors(dim, 400, dim, labels, spread)
    want = brute(rows, lambda i: i % 10 == 0, hn.Mining())
    assert want and mined(spark, rows, 10) == want


def test_groups_of_anchors_give_the_same(spark, monkeypatch):
    rows = vectors(7, 500, 8, 3, 1.0)
    monkeypatch.setattr(hn, "GROUP_BYTES", 1 << 10)  # on the driver, where anchors are grouped
    assert mined(spark, rows, 4, parts=6) == brute(rows, lambda i: i % 4 == 0, hn.Mining())


def test_ties_repeated_rows_and_a_hot_label(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, size=4)], int(rng.choice([1, 1, 1, 2, 3]))) for i in rng.integers(0, 60, size=200)]
    assert mined(spark, rows, 5) == brute(rows, lambda i: i % 5 == 0, hn.Mining())
    assert mined(spark, rows, 5, hn.Mining(positives=2, negatives=7, low=10, high=100)) == brute(rows, lambda i: i % 5 == 0, hn.Mining(positives=2, negatives=7, low=10, high=100))


def test_nulls_odd_numbers_and_lengths(spark):
    rows = vectors(5, 60, 6, 2, 1.0)
    odd = [(None, [1.0] * 6, 1), (60, None, 1), (70, [1.0] * 6, None), (80, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (90, [math.nan] * 6, 0), (100, [math.inf] * 6, 1), (110, [], 0), (120, [0.5, 0.5], 1), (130, [0.0] * 6, 0)]
    assert mined(spark, rows + odd, 10) == brute(rows + odd, lambda i: i is not None and i % 10 == 0, hn.Mining())


def test_few_rows(spark):
    assert mined(spark, [], 1) == Counter()
    assert mined(spark, [(0, [1.0], 1)], 1) == Counter()
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)], 10) == Counter()
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)], 2) == brute([(0, [], 1), (1, [], 1), (2, [], 2)], lambda i: i % 2 == 0, hn.Mining())


def test_products_that_fit_no_long(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        mined(spark, [(0, [1e300], 1), (1, [1.0], 1)], 1)


def test_large_components(spark):
    rows = [(i, [1e6 * x for x in v], label) for i, v, label in vectors(11, 120, 5, 2, 1.0)]
    assert mined(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0, hn.Mining())


def test_intervals_hold_every_pair_that_counts_and_few_others():
    rng = np.random.default_rng(1)
    ints = np.floor(256 * rng.normal(size=(3000, 64)) * np.geomspace(1, 0.02, 64)).astype(np.int32)
    rotation = hn.Rotation(ints[:500].astype(float), 64)
    make = lambda at: rotation.block(np.arange(3000)[at], np.arange(3000)[at], np.zeros(3000, dtype=np.int64)[at], ints[at])
    a, r = make(slice(0, 50)), make(slice(50, 3000))
    scores = a.ints.astype(np.int64) @ r.ints.T.astype(np.int64)
    least, most = np.quantile(scores, 0.98, axis=1), np.quantile(scores, 0.99, axis=1)
    x, y = rotation.between(a, r, least, most)
    assert (hn.exact(a, r, x, y) == scores[x, y]).all()
    inside = (scores >= least[:, None]) & (scores <= most[:, None])
    assert {*zip(x.tolist(), y.tolist(), strict=True)} >= {*zip(*(k.tolist() for k in np.nonzero(inside)), strict=True)}
    assert len(x) < 0.2 * scores.size
    assert rotation.cuts[0] < 16
