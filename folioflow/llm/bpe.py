"""BPE encoding and decoding by per-prefix dynamic programming.

A vocabulary whose ids follow its merges has one encoding per pre-token, and every prefix
of it has one encoding too. So one token per prefix is enough: an Aho-Corasick automaton
over the vocabulary (at each position of the text it reports all vocabulary entries that
end there, as a suffix automaton's matches would) gives the candidates for the last token of a prefix,
and a candidate is the last token exactly if it may stand after the last token of the
prefix before it. Following these back-pointers from the end gives the ids.

Pre-tokens repeat, so their ids are kept in a bounded table per Python worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of the byte-level pre-tokenizer. \p{White_Space} is what its library takes for \s.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens whose ids a worker keeps, twice: those met since the table was last full, and those met before.
KEPT = 300_000
#: Pre-tokens of more characters are not kept: they hardly repeat, and one may be as long as its text.
LONG = 200
#: Pairs of tokens whose compatibility a worker keeps.
PAIRS = 1_000_000
#: Later than any merge.
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Kept(dict):
    """Pre-token -> ids. When it is full it starts anew, and what is met again comes over from the table before; long ones are not kept."""

    def __init__(self, piece: Callable[[bytes], tuple[int, ...]]):
        super().__init__()
        self.piece, self.before = piece, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(word) > LONG:
            return self.piece(word.encode())
        if len(self) >= KEPT:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            ids = self.piece(word.encode())
        self[word] = ids
        return ids


class Bpe:
    """Encoder and decoder of one vocabulary file (JSON of a byte-level BPE model)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.id_of = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        #: left << 20 | right -> the token they merge into; the smaller the id, the earlier the merge
        self.merged: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for pair in spec["model"]["merges"]:
            left, right = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            a, b, c = self.id_of[left], self.id_of[right], self.id_of[left + right]
            self.merged.setdefault(a << 20 | b, c)
            self.halves.setdefault(c, (a, b))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        by_id = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.kept = Kept(self.piece)

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart side by side: no merge across their border would come before the merges that formed them.

        The border's neighbours are followed from their first bytes to a and b; at each
        step the merge across the border, if there is one, must not precede the merge
        that replaces a neighbour.
        """
        left, right, merged = self.edge(a, 1), self.edge(b, 0), self.merged.get
        i, j = len(left) - 1, len(right) - 1
        while True:
            across = merged(left[i] << 20 | right[j], NEVER + 1)
            # a neighbour lives until the merge of the next larger one
            ends_left, ends_right = left[i - 1] if i else NEVER, right[j - 1] if j else NEVER
            if ends_left <= ends_right:  # of merges with the same rank the left one comes first
                if across < ends_left:
                    return False
                if not i:
                    return True
                i -= 1
            else:
                if across <= ends_right:
                    return False
                j -= 1

    def edge(self, token: int, side: int) -> list[int]:
        """The token and, from it to a single byte, what stood at its right (1) or left (0) edge before each of its merges."""
        found = self.edges[side].get(token)
        if found is None:
            found = [token]
            while found[-1] in self.halves:
                found.append(self.halves[found[-1]][side])
            self.edges[side][token] = found
        return found

    def piece(self, raw: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        letters = raw.decode("latin-1")
        last: list = [None] * len(letters)  # (length, id) of the last token of each prefix
        pairs, known = self.pairs, self.pairs.get
        for end, found in self.automaton.iter(letters):
            if last[end] is not None:
                continue
            start = end - found[0]
            if start >= 0:
                before, token = last[start][1], found[1]
                key = before << 20 | token
                fits = known(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(before, token)
                if not fits:
                    continue
            last[end] = found
        if len(pairs) > PAIRS:
            pairs.clear()
        out, end = [], len(letters) - 1
        while end >= 0:
            length, token = last[end]
            out.append(token)
            end -= length
        return tuple(out[::-1])

    def encode(self, text: str) -> list[int]:
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        out: list[int] = []
        at = 0
        for m in self.split.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.kept.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_open: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The encoder of this worker for a vocabulary file."""
    if path not in _open:
        _open[path] = Bpe(path)
    return _open[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids and the decoded text.

    A null text counts as empty: no ids. Rows are independent, so repeated rows, null ids
    and empty tables need no rule; other columns of ``docs`` are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[], [], [], [], []]
                for text in part.column("text").to_pylist():
                    ids = codec.encode(text or "")
                    decoded = codec.decode(ids)
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(",".join(map(codec.text_of.__getitem__, ids)).encode()).hexdigest())
                    out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        out[3].append(ids)
                        out[4].append(decoded)
                made = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()), strict=True)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made][: 6 if with_ids else 4], names[: 6 if with_ids else 4])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, schema)
