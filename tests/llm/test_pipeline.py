from __future__ import annotations

import numpy as np
import pytest
from llm_data import documents, odd_texts, prose
from test_bpe_packing import PATH, check_pieces
from test_jaccard_join import brute
from tokenizers import Tokenizer

import corpus_pipeline as p
from folioflow.llm import exact_dedup


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """What each stage returns, in order."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append(docs)
    return out


def test_stages_in_order():
    assert [name for name, _ in p.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "secret_scan", "packing"]


def test_each_stage_equals_brute_force_on_its_input(spark, sf_dir, kept):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic, exact, near, clean, packed = kept
    assert all(df.columns == source.columns for df in kept[:4])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {r["doc_id"]: r["text"] for r in toxic.collect()}
    assert sum(i in left for i, x in labels.items() if x == 0) >= 0.9 * sum(x == 0 for x in labels.values())
    firsts = {}
    for i, text in left.items():
        key = "".join(c for c in text if c not in exact_dedup.WHITE_SPACE)
        firsts[key] = min(firsts.get(key, (1, 0)), (-len(text), i))
    after = {r["doc_id"]: r["text"] for r in exact.collect()}
    assert set(after) == {i for _, i in firsts.values()}
    assert {r["doc_id"] for r in near.collect()} == {cls for _, cls, _ in brute(list(after.items()))}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()}
    assert all(r["n_chars"] == len(r["text"]) and "AKIA" not in r["text"] for r in clean.collect())
    library = Tokenizer.from_file(PATH)
    docs = {r["doc_id"]: np.zeros(len(library.encode(r["text"], add_special_tokens=False).ids) + 1) for r in clean.collect()}
    pieces = [(r["doc_id"], r["start"], np.zeros(r["length"]), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in packed.collect()]
    assert check_pieces(pieces, docs, 2048) == 0


def test_the_run_equals_its_stages(spark, sf_dir, kept):
    # cuts depend on how rows are dealt, tokens do not
    tokens = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect())
    assert tokens(p.run(spark, sf_dir)) == tokens(kept[-1])


def test_odd_documents_pass_every_stage(spark, tmp_path):
    import random

    sf = str(tmp_path)
    spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    rng = random.Random(19)
    texts = odd_texts() + [prose(rng, 30)] * 2
    for ids in (list(range(len(texts))), [None] * len(texts)):
        docs = documents(spark, texts, ids)
        for _, stage in p.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() > 0
    docs = documents(spark, [])
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
