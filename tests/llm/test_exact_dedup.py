from __future__ import annotations

import hashlib
import random

import pandas as pd

from folioflow.llm import exact_dedup as e

from llm_data import documents, odd_texts, prose


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    groups: dict[str, list] = {}
    for i, (doc, text) in enumerate(rows):
        text = text or ""
        groups.setdefault("".join(c for c in text if c not in " \t\n\v\f\r"), []).append((-len(text), doc is None, doc or 0, i, doc))
    out = []
    for key, members in groups.items():
        first = min(members)
        out += [(m[4], first[4], len(members), m == first, hashlib.sha256(key.encode()).hexdigest()) for m in members]
    return sorted(map(str, out))


def check(spark, texts, ids=None, share=e.HEAVY_SHARE):
    df = documents(spark, texts, ids)
    got = e.exact_groups(df, heavy_share=share).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(list(zip(range(len(texts)) if ids is None else ids, texts, strict=True)))
    want = sorted(str((r["doc_id"], r["text_sha256"])) for r in e.exact_groups(df, heavy_share=share).where("kept").collect())
    for most in (e.MOST_IDS, 0):  # by a broadcast, and by a shuffle
        kept = e.drop_exact_copies(df, heavy_share=share, most_ids=most)
        assert kept.columns == df.columns
        digest = lambda text: hashlib.sha256("".join(c for c in text or "" if c not in e.WHITE_SPACE).encode()).hexdigest()
        assert sorted(str((r["doc_id"], digest(r["text"]))) for r in kept.collect()) == want


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    base = [prose(rng, 12) for _ in range(40)]
    texts = odd_texts() + [base[0]] * 200 + [t.replace(" ", "\n", 1) + " " for t in base] + base
    rng.shuffle(texts)
    for share in (1 / 2000, 1 / 10, 0.9):  # frequent digests: nearly all, one, none
        check(spark, texts, share=share)


def test_ties_nulls_and_repeated_rows(spark):
    check(spark, ["ab", "a b", "b a", "ab ", "ab ", "ab "], [5, 4, None, 9, 9, None])
    check(spark, [])
    check(spark, [None, None], [None, None])
    check(spark, ["x", "x", "y", "x ", "", None, "z", "z"], [1, 1, 1, 2, None, 3, 4, 4])


def test_columns_of_any_name_stay(spark):
    names = ["__id", "__sha", "__n", "__fate", "__KEY", "__digest", "__place", "digest", "kept", "rows", "stay", "place"]
    df = spark.createDataFrame([(1, "a b", *names), (1, "a b", *names), (2, "ab", *names), (None, "c", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = e.drop_exact_copies(df).collect()
    assert len(out) == 2 and all([r[n] for n in names] == names for r in out)


def test_texts_are_not_moved_where_ids_decide(spark):
    """With an id for each row the plan is one scan and one broadcast."""
    plan = e.drop_exact_copies(documents(spark, ["a", "a ", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Window" not in plan


def test_misra_gries_keeps_what_is_frequent():
    rng = random.Random(2)
    rows = [b"hot"] * 300 + [b"%d" % i for i in range(700)]
    rng.shuffle(rows)
    batches = [pd.DataFrame({"digest": rows[a : a + 64]}) for a in range(0, len(rows), 64)]
    (summary,) = e.misra_gries(iter(batches), 5)
    assert len(summary) <= 5 and b"hot" in set(summary["digest"])
    assert int(summary.set_index("digest").loc[b"hot", "seen"]) >= 300 - 1000 / 6
