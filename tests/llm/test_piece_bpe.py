from __future__ import annotations

import hashlib
import random
import time

import public_tokenizers
import pytest
import sentencepiece

from folioflow.llm import piece_bpe

from llm_data import documents, odd_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.Pieces(PATH)


def texts(rng: random.Random, vocabulary: list[str]) -> list[str]:
    letters = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x2581, 0x3000, *range(0x400, 0x450), *range(0x4E00, 0x4E20), *range(0x1F600, 0x1F620)]]
    odd = [*letters, "▁", " ", "  ", "        ", "<0x0A>", "<s>", "</s>", "<unk>", "the", " of", "aaaa", "12345"]
    return (
        ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(1000)]
        + ["".join(rng.choice("aeiothnsr ing  ,.()=-") for _ in range(60)) for _ in range(1000)]
        + ["".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(1000)]
        + [" " * rng.randint(0, 70) + rng.choice(["a", "\n", "the", ""]) + " " * rng.randint(0, 40) for _ in range(500)]
    )


def test_ids_and_texts_equal_the_library(codec, library):
    for text in [*texts(random.Random(1), codec.texts[259:]), *(t or "" for t in odd_texts())]:
        ids = library.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids)


def test_any_ids_decode_like_the_library(codec, library):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), 35, codec.id_of["▁"]]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def test_a_prefix_has_one_last_token(codec):
    """Of all pieces that end at a place exactly one is compatible with the last token of the text before it."""
    rng = random.Random(3)
    for _ in range(200):
        text = "▁" + "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 20)))
        last: list[str] = []
        for end in range(1, len(text) + 1):
            ends = [text[i:end] for i in range(end) if (end - i == 1 or text[i:end] in codec.rank and codec.story(text[i:end]) is not None)]
            fit = [t for t in ends if len(t) == end or codec.compatible(last[end - len(t) - 1], t)]
            assert len(fit) == 1
            last += fit
        at, out = len(text), []
        while at:
            out.append(last[at - 1])
            at -= len(last[at - 1])
        assert out[::-1] == codec.tokens(text)


def test_cuts_do_not_change_the_ids(codec):
    rng = random.Random(4)
    for text in rng.sample(texts(rng, codec.texts[259:]), 500):
        marked = "▁" + text.replace(" ", "▁")
        whole = codec.tokens(marked)
        assert [t for c in codec.chunks(marked) for t in codec.tokens(c)] == whole


def test_time_is_linear(codec):
    for text in (" " * 500_000, "a" * 500_000, "ab" * 250_000):
        begun = time.perf_counter()
        assert codec.decode(codec.encode(text)) == text
        assert time.perf_counter() - begun < 20


def field(number: int, value: bytes | int) -> bytes:
    return bytes([number << 3]) + bytes([value]) if isinstance(value, int) else bytes([number << 3 | 2, len(value)]) + value


@pytest.mark.parametrize(
    ("trainer", "normaliser", "kind"),
    [(field(3, 1), field(4, 0), 1), (field(3, 2), field(4, 1), 1), (field(3, 2), field(4, 0) + field(2, b"x"), 1), (field(3, 2), field(4, 0), 4), (field(3, 2), field(4, 0), 5)],
)
def test_other_models_are_refused(tmp_path, trainer, normaliser, kind):
    pieces = [field(1, field(1, b"<unk>") + field(3, 2)), field(1, field(1, b"a") + field(3, kind))]
    path = tmp_path / "model"
    path.write_bytes(b"".join(pieces) + field(2, trainer) + field(3, normaliser))
    with pytest.raises(ValueError, match="only"):
        piece_bpe.Pieces(str(path))


def test_the_operator(spark, library):
    given = odd_texts()
    got = {r["doc_id"]: r for r in piece_bpe.encode_decode(documents(spark, given), PATH).collect()}
    assert len(got) == len(given)
    for i, text in enumerate(given):
        ids = library.encode(text or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == library.decode(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert piece_bpe.encode_decode(documents(spark, ["a", "a"], [None, None]), PATH).count() == 2
    assert piece_bpe.encode_decode(documents(spark, []), PATH).count() == 0


def test_the_query_equals_the_library(spark, sf_dir, library):
    from folioflow.llm.queries import op13_sentencepiece

    stored = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op13_sentencepiece(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(stored)
    for r in rows:
        ids = library.encode(stored[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
