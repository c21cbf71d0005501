from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import bpe, packing

from llm_data import documents, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Bpe(PATH)


def strange(rng: random.Random) -> str:
    letters = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x85, 0xA0, 0x3000, 0x1680, 0xFEFF, *range(0x4E00, 0x4E20), *range(0x1F600, 0x1F620)]]
    return "".join(rng.choice([*letters, "<|endoftext|>", "<|endof", "'s", "'LL", "  ", "\n\n", "the", " of", "aaaa", "12345"]) for _ in range(rng.randint(0, 60)))


def test_ids_and_texts_equal_the_library(codec, library):
    rng = random.Random(4)
    texts = [strange(rng) for _ in range(1500)] + ["".join(rng.choice("aeiothnsr ing") for _ in range(50)) for _ in range(1000)] + [t or "" for t in odd_texts()]
    fast = packing.Encoder(PATH)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert fast(text).tolist() == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_token_encodes_to_itself(codec):
    assert all(codec.piece(raw) == (i,) for raw, i in codec.id_of.items())


def test_one_token_per_prefix_agrees_with_merging(codec):
    rng = random.Random(5)
    for _ in range(300):
        raw = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 25))).encode()
        ids = [codec.id_of[bytes([b])] for b in raw]
        while True:  # merge the earliest pair, again and again
            best = min(((codec.merged.get(a << 20 | b, bpe.NEVER), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))), default=(bpe.NEVER, 0))
            if best[0] == bpe.NEVER:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        assert codec.piece(raw) == tuple(ids)


def test_the_operator(spark, library):
    texts = odd_texts()
    got = {r["doc_id"]: r for r in bpe.encode_decode(documents(spark, texts), PATH).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == (text or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_decode(documents(spark, ["a", "a"], [None, None]), PATH).count() == 2
    assert bpe.encode_decode(documents(spark, []), PATH).count() == 0


def check_pieces(pieces: list[tuple], docs: dict, window: int) -> int:
    """Every id in exactly one piece, windows gapless and within bounds; the padding."""
    by_doc, by_window = {}, {}
    for doc, start, ids, total, sequence, offset in pieces:
        assert len(ids) and total == len(docs[doc])
        by_doc.setdefault(doc, []).append((start, ids))
        by_window.setdefault(sequence, []).append((offset, len(ids)))
    for doc, ids in docs.items():
        at = 0
        for start, part in sorted(by_doc[doc], key=lambda x: x[0]):
            assert start == at and list(part) == list(ids[start : start + len(part)])
            at += len(part)
        assert at == len(ids)
    padding = 0
    for parts in by_window.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_is_exact_and_without_padding():
    for seed in range(150):
        rng = random.Random(seed)
        window = rng.choice([8, 64, 2048])
        packer = packing.Packer(window, rng.choice([1, 3, 4096]))
        docs = {i: np.array([rng.randrange(9) for _ in range(rng.randint(1, rng.choice([3, window, 3 * window])))], dtype=np.uint32) for i in range(rng.choice([0, 1, 5, 200]))}
        pieces = [p for i, ids in docs.items() for p in packer.add(i, ids)] + packer.settle()
        assert check_pieces(pieces, docs, window) == 0


def test_a_piece_goes_where_the_sum_of_squares_grows_least():
    packer, rng = packing.Packer(32, 10**6), random.Random(8)
    for i in range(400):
        size = rng.randint(1, 31)
        count = packer.count.copy()

        def cost(level: int, size: int = size, count: np.ndarray = count) -> int:
            after = count.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return int((after**2).sum())

        best = min(cost(level) for level in range(0, 33 - size) if level == 0 or count[level])
        assert cost(packer.level_for(size)) == best
        packer.add(i, np.zeros(size, dtype=np.uint32))
        assert packer.count.sum() == packer.open == sum(map(len, packer.at.values()))


def test_the_packing_operator(spark, library):
    texts = odd_texts() * 3
    df = documents(spark, texts).repartition(3)
    rows = packing.pack(df, PATH).withColumn("crc", F.crc32("ids")).collect()
    docs = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype=np.uint32) for i, t in enumerate(texts)}
    pieces = [(r["doc_id"], r["start"], np.frombuffer(bytes(r["ids"]), dtype="<u4"), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in rows]
    assert check_pieces(pieces, docs, packing.WINDOW) == 0
    assert all(r["crc"] == zlib.crc32(bytes(r["ids"])) and r["length"] * 4 == len(r["ids"]) for r in rows)
    assert packing.pack(documents(spark, []), PATH).count() == 0
    assert packing.pack(documents(spark, ["a", "a"], [None, None]), PATH).count() >= 2


def test_large_ids_beside_null_ids(spark):
    df = documents(spark, ["a", "b", "c"], [2**53 + 1, None, 2**53 + 3]).coalesce(1)
    assert {r["doc_id"] for r in packing.pack(df, PATH).collect()} == {2**53 + 1, None, 2**53 + 3}


def test_the_packing_query_covers_every_document(spark, sf_dir, library):
    """What the query returns per document, against the library: tokens, and pieces without gaps that hold the right ids."""
    from folioflow.llm.queries import op8_packing

    rows = op8_packing(spark, sf_dir).collect()
    ids = {r["doc_id"]: np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in rows)
    pieces = [(r["doc_id"], r["start"], ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in rows]
    assert check_pieces(pieces, ids, packing.WINDOW) == 0
