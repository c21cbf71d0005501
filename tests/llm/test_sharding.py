from __future__ import annotations

import pytest
from llm_data import documents, odd_texts, prose
from pyspark.sql import functions as F

from folioflow.llm import sharding
from folioflow.llm.sharding import Conflict, Manifest, Shard, ShardStore

SIZES = {"smallest": 4000, "fanout": 4, "target": 60_000}


def rows(df):
    return sorted(str(r) for r in df.collect())


def test_arrivals_are_merged_and_none_is_lost(spark, tmp_path):
    import random

    rng = random.Random(15)
    store = ShardStore.create(spark, str(tmp_path / "s"), **SIZES)
    everything, merges = None, 0
    for i in range(12):
        arrival = documents(spark, [prose(rng, 60) for _ in range(25)] + odd_texts()[:7], [i * 100 + k for k in range(32)]).repartition(3)
        everything = arrival if everything is None else everything.unionByName(arrival)
        store.append(arrival)
        merges += store.compact()
        now = store.manifest()
        assert max([sum(s.tier == t for s in now.shards) for t in range(store.last)], default=0) < store.fanout
    want = rows(everything)
    assert merges >= 2 and len(now.shards) < 36
    assert rows(store.read()) == want
    assert store.vacuum() > 0 and rows(store.read()) == want and store.vacuum() == 0
    marked = store.read(with_shard=True)
    assert marked.count() == len(want) and marked.select("version").distinct().count() == 1
    assert {r["shard"] for r in marked.select("shard").collect()} == set(range(len(store.manifest().shards)))


def test_commits_are_atomic(spark, tmp_path):
    store = ShardStore.create(spark, str(tmp_path / "s"), **SIZES)
    df = documents(spark, ["a", "b"])
    first = store.append(df)
    with pytest.raises(Conflict):
        store.commit(Manifest(first.version, first.schema, ()))
    assert store.manifest() == first
    other = ShardStore(spark, str(tmp_path / "s"), **SIZES)
    second = other.append(df)  # a second writer goes on from the newest version
    assert second.version == 2 and store.read().count() == 4
    with pytest.raises(Conflict):
        store._change([], {"data/none"}, first.schema)
    df.write.parquet(str(tmp_path / "s" / "data" / "unfinished"))  # a job that never committed
    assert store.read().count() == 4 and store.vacuum() >= 1 and store.read().count() == 4


def test_commits_cost_what_has_changed(spark, tmp_path, monkeypatch):
    """Segments that keep their shards are taken over; small ones are written as one now and then."""
    monkeypatch.setattr(sharding, "SEGMENT", 10)
    monkeypatch.setattr(sharding, "FEW", 3)
    store = ShardStore.create(spark, str(tmp_path / "s"), **SIZES)
    shards = [Shard(f"data/j/{i}", 0, 1) for i in range(95)]
    written = []
    monkeypatch.setattr(store, "_put", lambda value, *names, put=store._put: (written.append(len(value)) if names[-1].startswith("segment") else None, put(value, *names)))
    store._change(shards[:40], set(), "{}")
    assert written == [10] * 4
    written.clear()
    store._change(shards[40:43], {"data/j/5"}, "{}")
    assert written == [10, 2]  # nine that are left, and three new ones
    for s in shards[43:60]:
        store._change([s], set(), "{}")
    again = ShardStore(spark, str(tmp_path / "s"), **SIZES)
    now = again.manifest()
    assert {s.name for s in now.shards} == {s.name for s in shards[:60]} - {"data/j/5"} and len(now.shards) == 59 and now == store.manifest()
    assert len(again._segments) < 12 and again.vacuum() > 0
    assert ShardStore(spark, str(tmp_path / "s"), **SIZES).manifest() == now


def test_several_arrivals_of_one_job(spark, tmp_path):
    store = ShardStore.create(spark, str(tmp_path / "s"), **SIZES)
    df = documents(spark, odd_texts() * 3).repartition(4)
    versions = [m.version for m in store.append_each(df, F.when(F.col("doc_id") % 7 == 0, 3).otherwise(0), 5)]
    assert versions == [1, 2, 3, 4, 5] and rows(store.read()) == rows(df) and not list((tmp_path / "s" / "staged").iterdir())
    assert all(len({x for x in store.manifest().shards if x.name.startswith(s.name.rpartition("/")[0])}) == s.of for s in store.manifest().shards)


def test_empty_stores_and_arrivals(spark, tmp_path):
    store = ShardStore.create(spark, str(tmp_path / "s"), **SIZES)
    assert store.compact() == 0 and store.vacuum() == 0
    with pytest.raises(FileNotFoundError):
        store.read()
    empty = documents(spark, [])
    assert store.append(empty).shards == ()
    assert store.read().schema.names == empty.columns and store.read(with_shard=True).count() == 0


def test_tiers():
    sizes = [1, 4000, 4001, 16_000, 16_001, 30_000, 30_001, 10**6]
    store = object.__new__(ShardStore)
    store.smallest, store.fanout, store.target = 4000, 4, 60_000
    assert [store.tier(s) for s in sizes] == [0, 0, 1, 1, 1, 1, 2, 2] and store.last == 2
    assert Shard("a", 0, 1) != Shard("a", 1, 1)


def test_merged_shards_are_of_the_wanted_size(spark, tmp_path):
    """Shards are packed into files by their bytes, not by their number."""
    import random

    rng = random.Random(16)
    store = ShardStore.create(spark, str(tmp_path / "s"), smallest=20_000, fanout=4, target=1_000_000)
    for i, n in enumerate((5, 5, 100, 5, 5, 5, 100, 5)):
        store.append(documents(spark, [prose(rng, 100) for _ in range(n)], [i * 1000 + k for k in range(n)]).coalesce(1))
    small = [s.size for s in store.manifest().shards if s.tier == 0]
    assert store.compact() >= 1
    risen = [s.size for s in store.manifest().shards if s.tier >= 1]
    assert len(small) >= 4 and all(size <= 1.3 * 80_000 for size in risen) and store.read().count() == 230


def test_columns_of_any_name_stay(spark, tmp_path):
    store = ShardStore.create(spark, str(tmp_path / "s"), **SIZES)
    store.append(spark.createDataFrame([(1, "mine", 7, "f")], "doc_id long, shard string, Tier int, __file string"))
    assert store.read(with_shard=True).columns == ["doc_id", "shard", "Tier", "__file", "shard_", "tier_", "version"]
    assert tuple(store.read(with_shard=True).first())[:4] == (1, "mine", 7, "f")


def test_the_query_compacts_and_reads_all_documents(spark, sf_dir):
    from folioflow.llm.queries import op5_sharding
    from folioflow.llm.sharding import in_arrivals

    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["text_sha256"] for r in op5_sharding(spark, sf_dir).collect()}
    docs = source.select("doc_id", F.sha2("text", 256).alias("h"))
    assert got == {r["doc_id"]: r["h"] for r in docs.collect()}
    store, merges = in_arrivals(source)
    assert merges > 0 and max(s.tier for s in store.manifest().shards) >= 1
