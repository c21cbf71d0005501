from __future__ import annotations

import random
from collections import Counter, defaultdict
from dataclasses import replace

import pytest

from folioflow.llm import jaccard_join as j
from folioflow.llm.components import components

from llm_data import documents, odd_texts, prose


def brute(rows: list[tuple[int | None, str | None]], words: int = 5, least: float = 0.8) -> Counter:
    sets = []
    for _, text in rows:
        w = (text or "").split()
        k = min(words, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n >= least * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = Counter()
    for members in groups.values():
        known = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[rows[i][0], min(known) if known else None, links[i]] += 1
    return out


def near_copies(rng: random.Random, n: int, changed: float) -> list[str]:
    words = prose(rng, 120).split()
    return [" ".join(w if rng.random() > changed else f"x{rng.randrange(10**6)}" for w in words) for _ in range(n)]


def check(spark, texts, ids=None, params=None):
    params = params or j.Join()
    df = documents(spark, texts, ids)
    rows = list(zip(range(len(texts)) if ids is None else ids, texts, strict=True))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in j.join(df, params=params).collect())
    assert got == brute(rows)
    return df


def test_links_and_classes_equal_brute_force(spark):
    rng = random.Random(11)
    shared = prose(rng, 60)  # a passage that many documents have
    texts = odd_texts() + [f"{prose(rng, 80)} {shared} {prose(rng, 20)}" for _ in range(40)]
    for changed in (0.0, 0.005, 0.01, 0.02):
        texts += near_copies(rng, 12, changed)
    rng.shuffle(texts)
    df = check(spark, texts)
    kept = j.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len({k[1] for k in brute(list(enumerate(texts)))})


def test_large_nodes_and_blocks(spark):
    """Small limits: nodes are split and dissolved by pivots, and components are compared in blocks."""
    rng = random.Random(12)
    texts = near_copies(rng, 60, 0.004) + near_copies(rng, 40, 0.012) + [prose(rng, 50) for _ in range(20)]
    check(spark, texts, params=replace(j.Join(), leaf=4, block=8))
    check(spark, texts, params=replace(j.Join(), leaf=4, block=200, block_shingles=3000))
    check(spark, texts, params=replace(j.Join(), leaf=4, block=4, large_block=16, cell=3, large_cell=7))


def test_deep_trees_lose_no_link(spark, monkeypatch):
    """Documents too little alike for a core and too much for one split: nodes go on to be split, level by level."""
    rng = random.Random(15)
    texts = []
    for text in near_copies(rng, 160, 0.05):
        words = text.split()
        words[rng.randrange(len(words))] = f"y{rng.randrange(10**6)}"
        texts += [text, " ".join(words)]
    levels = []
    monkeypatch.setattr(j, "from_pivots", lambda rows, f=j.from_pivots: levels.append(1) or f(rows))
    df = check(spark, texts, params=replace(j.Join(), leaf=3))
    assert len(levels) >= 4
    assert j.join(df, params=replace(j.Join(), leaf=3)).where("n_links > 0").count() >= 300


def test_no_plan_spans_the_levels(spark, monkeypatch, capsys):
    """However deep the trees, no plan has joins for each of their levels, also when large components are told apart."""
    rng = random.Random(15)
    texts = near_copies(rng, 20, 0.002) + near_copies(rng, 100, 0.05)
    levels, joins = [], {}

    def counted(df, label, slim=False, f=j.cut):
        capsys.readouterr()
        df.explain()
        joins[label] = max(joins.get(label, 0), sum("Join " in x for x in capsys.readouterr().out.splitlines()))
        return f(df, label, slim)

    monkeypatch.setattr(j, "cut", counted)
    monkeypatch.setattr(j, "from_pivots", lambda rows, f=j.from_pivots: levels.append(1) or f(rows))
    check(spark, texts, params=replace(j.Join(), leaf=3, block=4))
    assert len(levels) >= 4 and "jaccard-pairs" in joins
    assert max(n for label, n in joins.items() if label.startswith("chosen-path")) <= 10
    assert joins["jaccard-cells"] <= 10, joins


def chain(n: int, step: int = 11, words: int = 104) -> list[str]:
    """Texts of which each is just similar enough to the one before and the one after."""
    return [" ".join(f"w{k}" for k in range(i * step, i * step + words)) for i in range(n)]


def test_a_chain_costs_its_candidates(spark):
    """A component of thousands, production parameters: only candidates are compared, and their sets copied a few times."""
    n, figures = 3000, {}
    rows = j.join(documents(spark, chain(n)), figures=figures).collect()
    assert {r["class_id"] for r in rows} == {0}
    assert Counter(r["n_links"] for r in rows) == {2: n - 2, 1: 2}
    assert figures["pairs"] < 20_000 and figures["copies"] < 10 * n


def test_large_components_of_all_kinds(spark):
    """Chains, groups that are all alike, chains through such groups, and copies, with limits so small that each is told apart."""
    rng = random.Random(21)
    texts = chain(60) + near_copies(rng, 40, 0.002)
    for text in chain(30, 11, 104)[::7]:
        words = text.split()
        for _ in range(12):
            at = rng.randrange(len(words))
            texts.append(" ".join([*words[:at], f"z{rng.randrange(10**6)}", *words[at + 1 :]]))
    texts += texts[::9]
    rng.shuffle(texts)
    for sparse in (1, 3, 12, 10**6):
        check(spark, texts, params=replace(j.Join(), leaf=16, block=8, large_block=16, cell=16, large_cell=32, sparse=sparse))


def test_the_bound_on_runs():
    p = j.Join()
    assert p.found(p.runs) >= p.recall > p.found(p.runs - 1)
    # the chance that a line dies out, against a simulation of 30 levels
    rng = random.Random(16)
    for s in (0.6, 0.8):
        alive = 0
        for _ in range(3000):
            lines = 1
            for _ in range(30):
                lines = min(60, sum(rng.random() < s for _ in range(2 * lines)))
            alive += lines > 0
        assert abs(1 - alive / 3000 - j.extinct(s, 2)) < 0.03
    with pytest.raises(ValueError):
        replace(p, recall=1.0).runs  # noqa: B018


def test_recall_on_stored_documents(spark):
    """Production parameters: the links of every hundredth document against all others, by brute force."""
    import os

    sf = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(sf):
        pytest.skip("no tables of this size")
    docs = spark.read.parquet(sf)
    sets, holders = {}, defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        w = (r["text"] or "").split()
        k = min(5, len(w))
        sets[r["doc_id"]] = {hash(tuple(w[i : i + k])) for i in range(len(w) - k + 1)} if w else set()
    for i, found in sets.items():
        for x in found:
            holders[x].append(i)
    want = {}
    for i in sets:
        if i % 100 == 0:
            common = Counter(other for x in sets[i] for other in holders[x] if other != i)
            want[i] = sum(n >= 0.8 * (len(sets[i]) + len(sets[other]) - n) - 1e-9 for other, n in common.items())
    got = {r["doc_id"]: r["n_links"] for r in j.join(docs).where("doc_id % 100 = 0").collect()}
    found, links = sum(min(got[i], n) for i, n in want.items()), sum(want.values())
    assert links >= 20 and found >= 0.999 * links and all(got[i] <= n for i, n in want.items())


def test_large_ids_and_columns_of_any_name(spark):
    rows = [(2**53 + 1, "a b c d e f", "k1"), (None, "z", "k2"), (2**53 + 3, "a b c d e f", "k3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key string").coalesce(1)
    got = sorted((str(r["doc_id"]), r["class_id"], r["n_links"]) for r in j.join(df).collect())
    assert got == [(str(2**53 + 1), 2**53 + 1, 1), (str(2**53 + 3), 2**53 + 1, 1), ("None", None, 0)]
    assert sorted(r["__key"] for r in j.one_of_each(df).collect()) == ["k1", "k2"]


def test_ties_nulls_and_repeated_rows(spark):
    check(spark, ["a b c d e f"] * 3 + [None, "", "z"], [None, 4, 4, None, 2, None])
    assert j.join(documents(spark, [])).count() == 0
    assert j.one_of_each(documents(spark, [])).count() == 0


def test_recall_at_the_threshold(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(150):  # pairs that are just similar enough
        w = prose(rng, 200).split()
        v = list(w)
        for at in (20, 70, 120, 170):
            v[at] = f"y{rng.randrange(10**6)}"
        texts += [" ".join(w), " ".join(v)]
    check(spark, texts)


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(i % 7 + 200, i) for i in range(150)]])
def test_components(spark, edges):
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), hub=0.05).collect()}
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in parent}
