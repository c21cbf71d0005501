"""Small documents with every odd case, shared by the tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, d string, k long, digest string, win string, ids string, path string, mask string"


def prose(rng: random.Random, words: int) -> str:
    stems = "the and of in tion ing er re an at ha wh ou sh ly st en ed nd or".split()
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(words))


def documents(spark, texts: list[str | None], ids: list[int | None] | None = None):
    """A table of documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, None, None if t is None else len(t), "x", 1, None, "w", "i", "p", "m") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts() -> list[str | None]:
    rng = random.Random(3)
    long = prose(rng, 30_000)
    return [None, "", " ", "\n\t", "a", "one two three four", prose(rng, 40), prose(rng, 40), long, long, "é" * 50, "😀 " * 30, "x" * 5000, None, ""]
