"""SentencePiece encoding and decoding (BPE models) by a table of last tokens per prefix.

Such a model merges, again and again, the two neighbours whose joint piece has the best
score, the leftmost of equals; which two parts a piece is made of is not fixed beforehand. Still every
text has one encoding, and so has every prefix of it, which makes the table sound:

* A piece of the vocabulary is reached in one way only: merged alone, its characters give
  the piece by one sequence of merges (its story), as nothing outside a final token ever crosses its ends.
* Tokens a, b stand side by side in an encoding exactly if merging a's and b's characters
  together plays both stories through, in the order of their scores, before any merge across the border would be due.
* A sequence is an encoding exactly if all its neighbours are compatible in this way: what
  is due at one border depends on the two stories beside it alone.

So an Aho-Corasick automaton over the vocabulary gives the candidates for the last token of a
prefix, and the one that is compatible with the last token of the prefix before it is
stored; there is never another. Following these tokens from the end gives the ids.

A text is cut where no piece of the vocabulary can lie across (before white space, between letters and
marks, around characters that no longer piece has; all read off the vocabulary), and the ids of short
chunks are kept in a bounded table per Python worker.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the model files: kinds of pieces, the mark that stands for a space, the model kind for BPE.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
SPACE = "▁"
BPE_MODEL = 2
#: Chunks whose ids a worker keeps, twice: those met since the table was last full, and those met before.
KEPT = 300_000
#: Chunks of more characters are not kept.
LONG = 200
#: Pairs of tokens whose compatibility a worker keeps.
PAIRS = 1_000_000
NEVER = float("inf")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message in the model file's wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class Kept(dict):
    """Chunk -> ids. When it is full it starts anew, and what is met again comes over from the table before; long chunks are not kept."""

    def __init__(self, ids: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.ids, self.before = ids, {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(chunk) > LONG:
            return self.ids(chunk)
        if len(self) >= KEPT:
            self.before = dict(self)
            self.clear()
        found = self.before.get(chunk)
        if found is None:
            found = self.ids(chunk)
        self[chunk] = found
        return found


class Pieces:
    """Encoder and decoder of one model file.

    Raises ValueError for what is not covered: other kinds of models, pieces that are user-defined
    or unused, and normalisers that change more than white space marks.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        trainer, normaliser = ({k: v for n, raw in parts if n == m for k, v in fields(raw)} for m in (2, 3))
        entries = [{k: v for k, v in fields(raw)} for n, raw in parts if n == 1]
        self.texts = [e[1].decode() for e in entries]
        self.kinds = [e.get(3, NORMAL) for e in entries]
        if trainer.get(3, 1) != BPE_MODEL or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only BPE models without user-defined or unused pieces are read")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only models whose normaliser keeps the text are read")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer[44].decode() if 44 in trainer else " ⁇ "
        self.byte_of = {i: int(t[3:5], 16) for i, t in enumerate(self.texts) if self.kinds[i] == BYTE}
        self.byte_ids = {b: i for i, b in self.byte_of.items()} if trainer.get(35) else {}
        self.id_of = {t: i for i, t in enumerate(self.texts) if self.kinds[i] == NORMAL}
        #: the smaller, the earlier a merge into this piece
        self.rank = {t: -struct.unpack("<f", entries[i][2])[0] for t, i in self.id_of.items() if len(t) > 1}
        self.text_of = [str(i) for i in range(len(self.texts))]
        self.stories: dict[str, tuple[tuple[float, str, str], ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            if self.story(piece) is not None:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.chunks = re.compile(self.pattern()).findall
        self.kept = Kept(self.ids)
        #: the text of each id; bytes above 127 are lone surrogates until all are joined
        self.shown = [self.unknown_text if k == UNKNOWN else "" if k == CONTROL else t for t, k in zip(self.texts, self.kinds, strict=True)]
        for i, b in self.byte_of.items():
            self.shown[i] = bytes([b]).decode("utf-8", "surrogateescape")

    def pattern(self) -> str:
        """An expression whose matches, one after the other, are the chunks that no piece lies across."""
        longer = [t for t in self.rank]
        bound = {c for t in longer for c in t}
        marks_inside = any(SPACE in t.lstrip(SPACE) for t in longer)
        mixed = any(a.isalpha() != b.isalpha() for t in longer for a, b in zip(t, t[1:], strict=False) if SPACE not in (a, b))
        kind = lambda chars: "".join(map(re.escape, sorted(chars)))
        letters, others = ({c for c in bound - {SPACE} if c.isalpha() == x} for x in (True, False))
        groups = [kind(bound - {SPACE})] if mixed else [kind(letters), kind(others)]
        if marks_inside or not all(groups):
            return "(?s).+"
        return "|".join([*(f"{SPACE}*[{g}]+" for g in groups), f"{SPACE}+", f"[^{kind(bound)}]"])

    def story(self, token: str) -> tuple[tuple[float, str, str], ...] | None:
        """What the merges of a token's characters do, in order: rank of the merge, and the left and the right end's piece after it. None if they do not end in the token."""
        if token not in self.stories:
            parts, out = list(token), []
            while len(parts) > 1:
                best, at = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                out.append((best, parts[0], parts[-1]))
            self.stories[token] = tuple(out) if len(parts) == 1 else None
        return self.stories[token]

    def compatible(self, a: str, b: str) -> bool:
        """Whether a and b stay apart side by side: at no time is a merge across their border the next one.

        Of merges with the same rank the leftmost comes first: a's, the one across, b's.
        """
        left, right = self.story(a), self.story(b)
        i, j, end, start = 0, 0, a[0] if len(a) == 1 else a[-1], b[0]
        while True:
            across = self.rank.get(end + start, NEVER)
            next_left, next_right = left[i][0] if i < len(left) else NEVER, right[j][0] if j < len(right) else NEVER
            if across < next_left and across <= next_right:
                return False
            if i == len(left) and j == len(right):
                return True
            if next_left <= next_right:
                end = left[i][2]
                i += 1
            else:
                start = right[j][1]
                j += 1

    def tokens(self, marked: str) -> list[str]:
        """The tokens of a text whose spaces are marks already."""
        last = list(marked)  # the last token of each prefix; where no longer one fits, the character alone
        pairs, known = self.pairs, self.pairs.get
        for end, piece in self.automaton.iter(marked):
            start = end - len(piece)
            if start >= 0:
                key = (last[start], piece)
                fits = known(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(*key)
                if not fits:
                    continue
            last[end] = piece
        if len(pairs) > PAIRS:
            pairs.clear()
        out, end = [], len(marked) - 1
        while end >= 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def ids(self, chunk: str) -> tuple[int, ...]:
        """The ids of one chunk."""
        out: list[int] = []
        for token in self.tokens(chunk):
            i = self.id_of.get(token)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in token.encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = text.replace(" ", SPACE)
        return list(chain.from_iterable(map(self.kept.__getitem__, self.chunks(SPACE + marked if self.dummy_prefix else marked))))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any ids: controls give nothing, byte pieces in a row give their characters (U+FFFD for each byte that starts none), the first mark goes where encoding put one."""
        text = "".join(map(self.shown.__getitem__, ids))
        if self.dummy_prefix and text.startswith(SPACE):
            text = text[1:]
        text = text.replace(SPACE, " ")
        return text if text.isascii() else characters(text.encode("utf-8", "surrogateescape"))


def characters(raw: bytes) -> str:
    """Bytes as UTF-8; each byte that starts no whole character gives U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + characters(raw[e.start + 1 :])


_open: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The encoder of this worker for a model file."""
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids and the decoded text.

    A null text counts as empty: no ids. Texts of any length are encoded whole, in time and memory linear in them. Rows are
    independent, so ties, repeated rows, null ids and empty tables need no rule; other
    columns of ``docs`` are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces(path)
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
                made = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made][: len(names)], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, schema)
