"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector next to the mean of the vectors of its character
n-grams, so words that training never saw still say something. Two gated recurrent
layers read a window of words in both directions; attention pools their states; a
logistic unit scores the window. A document's score is the highest of its windows, which
overlap and cover the whole text.

The network is trained here, in numpy, on a bounded sample of labelled rows. Labels belong
to documents, so training has two parts: first every window of a sample carries its
document's label; then single windows stand for their documents, the one that scores highest
for a toxic document, the highest and a random one for a clean document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """sample_toxic, sample_clean, sample_chars: bounds of the training sample (rows, and code points of a text).
    window, stride: words of a window and between windows. threshold: of a score that rejects.
    least_docs: documents in which a word of the vocabulary occurs. unread: the share of words read by their characters alone.
    repeated: clean windows that are read as one repeated word, for each other window.
    first_windows, first_epochs, first_steps: how many windows of all kinds are read, how often, and in how many steps at least, before single windows stand for documents.
    distrust: the logit that a toxic row must reach to be learned from, after that. epochs, least_steps: of that second part."""

    sample_toxic: int = 1500
    sample_clean: int = 3500
    sample_chars: int = 10_000
    window: int = 64
    stride: int = 48
    states: int = 12
    word_size: int = 12
    char_size: int = 12
    buckets: int = 32768
    least_docs: int = 3
    decay: float = 1e-2
    toxic_weight: float = 2.0
    unread: float = 0.5
    repeated: float = 0.1
    first_windows: int = 12_000
    first_epochs: int = 2
    first_steps: int = 180
    distrust: float = -2.0
    epochs: int = 4
    least_steps: int = 200
    batch: int = 128
    rate: float = 1e-2
    threshold: float = 0.3
    seed: int = 7


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


#: Lengths of the character n-grams of a word between its bounds.
GRAMS = (3, 4, 5)


class Grams:
    """The n-gram buckets of many words: those of word i are flat[begin[i]:begin[i + 1]]."""

    def __init__(self, flat: np.ndarray, begin: np.ndarray):
        self.flat, self.begin = flat, begin

    @classmethod
    def of(cls, words: list[str], buckets: int) -> Grams:
        """Hashes of all n-grams of the words between their bounds, by a polynomial over the code points of all words at once."""
        size = np.array([len(w) + 2 for w in words], dtype=np.int64)
        code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(code))
        per = [np.maximum(size - n + 1, 0) for n in GRAMS]
        begin = np.r_[0, np.cumsum(sum(per))]
        flat = np.empty(begin[-1], dtype=np.int32)
        before = begin[:-1].copy()
        for n, count in zip(GRAMS, per, strict=True):
            here = at[at + n <= (first + size)[word]]
            h = np.full(len(here), n, dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + code[here + j]
                h ^= h >> np.uint64(29)
            flat[(before - first)[word[here]] + here] = (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % np.uint64(buckets)
            before += count
        return cls(flat, begin)

    def take(self, which: np.ndarray) -> Grams:
        size = (self.begin[1:] - self.begin[:-1])[which]
        begin = np.r_[0, np.cumsum(size)]
        return Grams(self.flat[np.repeat(self.begin[:-1][which] - begin[:-1], size) + np.arange(begin[-1])], begin)


def starts(n: int, window: int, stride: int) -> np.ndarray:
    """Where the windows of a text of n words begin: every stride, the last one ending with the text; an empty text has one window."""
    if n <= window:
        return np.zeros(1, dtype=np.int64)
    s = np.arange(0, n - window, stride)
    return np.append(s, n - window)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights: words, chars (tables), wx (2, inputs, 3H), u (2, H, 3H), b (2, 3H), attention (2H), out (2H), bias (1)."""

    def __init__(self, vocabulary: dict[str, int], s: Settings):
        rng = np.random.default_rng(s.seed)
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        h, inputs = s.states, s.word_size + s.char_size
        self.vocabulary, self.s = vocabulary, s
        self.w = {
            "words": normal(0.1, len(vocabulary) + 1, s.word_size),  # row 0: a word that is not in the vocabulary
            "chars": normal(0.1, s.buckets, s.char_size),
            "wx": normal(inputs**-0.5, 2, inputs, 3 * h),
            "u": normal(h**-0.5, 2, h, 3 * h),
            "b": np.zeros((2, 3 * h), dtype=np.float32),
            "attention": normal(0.1, 2 * h),
            "out": normal(0.3, 2 * h),
            "bias": np.full(1, -1.0, dtype=np.float32),
        }

    def char_vectors(self, grams: Grams) -> np.ndarray:
        """The mean of each word's n-gram vectors."""
        return np.add.reduceat(self.w["chars"][grams.flat], grams.begin[:-1], axis=0) / np.diff(grams.begin)[:, None].astype(np.float32)

    def inputs(self, words: list[str]) -> np.ndarray:
        known = np.array([self.vocabulary.get(x, 0) for x in words])
        return np.concatenate([self.w["words"][known], self.char_vectors(Grams.of(words, self.s.buckets))], axis=1)

    def projected(self, words: list[str]) -> np.ndarray:
        """(2, words, 3H): what each word adds to the gates of both directions; it depends on nothing else."""
        x = self.inputs(words)
        return np.stack([x @ self.w["wx"][d] + self.w["b"][d] for d in (0, 1)])

    def states(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What run() gives, without a trace and in place: every array of the loop is reused."""
        n, length = index.shape
        k, w = self.s.states, self.w
        h, x, hu = (np.zeros((2, n, f * k), dtype=np.float32) for f in (1, 3, 3))
        spare = np.empty_like(h)
        out = np.empty((length, n, 2 * k), dtype=np.float32)
        whole, m = bool(mask.all()), mask.astype(np.float32)
        ways = np.ascontiguousarray(index.T)
        for t in range(length):
            back = length - 1 - t
            np.take(table[0], ways[t], axis=0, out=x[0], mode="clip")
            np.take(table[1], ways[back], axis=0, out=x[1], mode="clip")
            np.matmul(h, w["u"], out=hu)
            gates, new = x[..., : 2 * k], x[..., 2 * k :]
            gates += hu[..., : 2 * k]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[..., k:], hu[..., 2 * k :], out=spare)
            new += spare
            np.tanh(new, out=new)
            if whole:
                h -= new
                h *= gates[..., :k]
                h += new
            else:
                np.subtract(h, new, out=spare)
                spare *= gates[..., :k]
                spare += new
                spare -= h
                spare[0] *= m[:, t, None]
                spare[1] *= m[:, back, None]
                h += spare
            out[t, :, :k] = h[0]
            out[back, :, k:] = h[1]
        return out, m

    def pool(self, states: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, attention (L, n) and pooled states; a window without words pools zeros."""
        e = states @ self.w["attention"]
        e = np.where(m.T > 0, e, np.float32(-1e9))
        a = np.exp(e - e.max(axis=0)) * m.T
        a /= np.maximum(a.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("ln,lnh->nh", a, states)
        return pooled @ self.w["out"] + self.w["bias"][0], a, pooled

    def logits(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The logits of windows; table is (2, words, 3H), one contiguous block for each direction."""
        return self.pool(*self.states(table, index, mask))[0]


def summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of values that have the same index, for indices 0 to n - 1."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    begins = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    out = np.zeros((n, values.shape[1]), dtype=values.dtype)
    out[index[begins]] = np.add.reduceat(values[order], begins, axis=0)
    return out


def gradients(net: Network, words: np.ndarray, grams: Grams, index: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of one batch. words: vocabulary row of each distinct word; index (n, L) points into these.

    Axes of what is kept of the way forth are time, direction, window, unit; the second
    direction's time runs backwards.
    """
    w, k, (n, length) = net.w, net.s.states, index.shape
    x_all = np.concatenate([w["words"][words], net.char_vectors(grams)], axis=1)
    at = np.stack([index.T, index.T[::-1]], axis=1)  # (L, 2, n)
    there = np.stack([mask.T, mask.T[::-1]], axis=1)[..., None].astype(x_all.dtype)
    whole = bool(mask.all())
    x = np.stack([(x_all @ w["wx"][d] + w["b"][d])[at[:, d]] for d in (0, 1)], axis=1)
    h = np.zeros((length + 1, 2, n, k), dtype=x.dtype)
    gate, hu_new, new = np.empty((length, 2, n, 2 * k), dtype=x.dtype), np.empty((length, 2, n, k), dtype=x.dtype), np.empty((length, 2, n, k), dtype=x.dtype)
    for t in range(length):
        hu = np.matmul(h[t], w["u"])
        gate[t] = sigmoid(x[t, ..., : 2 * k] + hu[..., : 2 * k])
        hu_new[t] = hu[..., 2 * k :]
        new[t] = np.tanh(x[t, ..., 2 * k :] + gate[t, ..., k:] * hu_new[t])
        after = new[t] + gate[t, ..., :k] * (h[t] - new[t])
        h[t + 1] = after if whole else h[t] + there[t] * (after - h[t])
    states = np.concatenate([h[1:, 0], h[1:, 1][::-1]], axis=2)
    logit, a, pooled = net.pool(states, mask.astype(x.dtype))
    p = sigmoid(logit)
    loss = float(-(weight * (target * np.log(p + 1e-7) + (1 - target) * np.log(1 - p + 1e-7))).sum() / weight.sum())

    d_logit = (weight * (p - target) / weight.sum()).astype(x.dtype)
    g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * w["out"]
    d_a = np.einsum("lnh,nh->ln", states, d_pooled)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    g["attention"] = np.einsum("ln,lnh->h", d_e, states)
    d_states = a[..., None] * d_pooled + d_e[..., None] * w["attention"]
    d_out = np.stack([d_states[..., :k], d_states[::-1, :, k:]], axis=1)
    d_x, d_hu = np.empty_like(x), np.empty_like(x)
    d_h, back = np.zeros((2, n, k), dtype=x.dtype), w["u"].transpose(0, 2, 1)
    for t in reversed(range(length)):
        z, r = gate[t, ..., :k], gate[t, ..., k:]
        d_h += d_out[t]
        d_after = d_h if whole else d_h * there[t]
        d_new = d_after * (1 - z) * (1 - new[t] * new[t])
        d_x[t, ..., :k] = d_after * (h[t] - new[t]) * z * (1 - z)
        d_x[t, ..., k : 2 * k] = d_new * hu_new[t] * r * (1 - r)
        d_x[t, ..., 2 * k :] = d_new
        d_hu[t, ..., : 2 * k] = d_x[t, ..., : 2 * k]
        d_hu[t, ..., 2 * k :] = d_new * r
        d_before = d_after * z + np.matmul(d_hu[t], back)
        d_h = d_before if whole else d_before + d_h * (1 - there[t])
    flat = lambda v, d: v[:, d].reshape(length * n, -1)
    g["u"] = np.stack([flat(h[:-1], d).T @ flat(d_hu, d) for d in (0, 1)])
    d_table = [summed(at[:, d].reshape(-1), flat(d_x, d), len(words)) for d in (0, 1)]
    g["b"] = np.stack([d.sum(axis=0) for d in d_table])
    g["wx"] = np.stack([x_all.T @ d for d in d_table])
    d_all = sum(d_table[d] @ w["wx"][d].T for d in (0, 1))
    g["words"] = summed(words, d_all[:, : net.s.word_size], len(w["words"]))
    size = np.diff(grams.begin)
    g["chars"] = summed(grams.flat, np.repeat(d_all[:, net.s.word_size :] / size[:, None].astype(x.dtype), size, axis=0), len(w["chars"]))
    return loss, g


class Adam:
    """Steps of all weights by the gradients' first two moments, with decay of all but the bias."""

    def __init__(self, net: Network):
        self.net, self.step = net, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
        self.mean, self.remembered = net.w, 0

    def __call__(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        for k, v in g.items():
            m, q = self.moments[k]
            m += 0.1 * (v - m)
            q += 0.001 * (v * v - q)
            if k != "bias":
                self.net.w[k] -= self.net.s.decay * rate * self.net.w[k]
            self.net.w[k] -= (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(q / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)

    def remember(self) -> None:
        """Take the weights as they are now into their mean, which varies less than any of them."""
        self.remembered += 1
        self.mean = {k: v.copy() if self.remembered == 1 else self.mean[k] + (v - self.mean[k]) / np.float32(self.remembered) for k, v in self.net.w.items()}


def fit(texts: list[str], toxic: list[int], s: Settings) -> Network | float:
    """The trained network; where one of the labels is missing, the share of toxic rows (0 without rows).

    Of texts with the same words in the same order the first row counts, with its label.
    Nothing but the network learns from the labels: no word counts enter it. First, every
    window has the label of its document. Then a document is judged by windows as the
    network sees them: a toxic one by its highest, a clean one by its highest and a random one.
    """
    seen: set[bytes] = set()
    place: dict[str, int] = {}
    ids, y = [], []
    for at, label in enumerate(toxic):
        words, texts[at] = words_of(texts[at]), ""  # what is read is let go
        key = hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()  # copies of a document would count again and again
        if words and key not in seen:
            seen.add(key)
            ids.append(np.array([place.setdefault(w, len(place)) for w in words], dtype=np.int32))
            y.append(int(label))
    target = np.array(y, dtype=np.float32)
    if not 0 < target.sum() < len(target):
        return float(target.mean()) if len(target) else 0.0
    total = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=len(place))
    rows = np.zeros(len(place), dtype=np.int64)  # the row of each word in the vocabulary, 0 outside it
    often = np.flatnonzero(total >= s.least_docs)
    rows[often] = np.arange(1, len(often) + 1)
    names = list(place)
    net = Network({names[i]: int(rows[i]) for i in often}, s)
    grams = Grams.of(names, s.buckets)
    del place
    owner, index, mask = windows(ids, s)
    rng, adam = np.random.default_rng(s.seed), Adam(net)
    clean = np.flatnonzero(target[owner] == 0)
    first = np.flatnonzero(rng.random(len(owner)) < s.first_windows / len(owner))
    each = -(-2 * len(ids) // s.batch)  # steps of an epoch by single windows, about
    before = max(s.first_epochs, -(-s.first_steps // max(1, -(-len(first) // s.batch))))
    epochs = max(s.epochs, -(-s.least_steps // each))
    for epoch in range(before + epochs):
        if epoch < before:
            chosen = first
        else:
            score = scored(net, rows, grams, index, mask)
            best, other = best_of(owner, score, len(ids)), best_of(owner, rng.random(len(owner)), len(ids))
            # a toxic row in which nothing looks toxic by now is taken for a wrong label and left out of this epoch
            trusted = (target == 0) | (score[best] > s.distrust)
            chosen = np.concatenate([best[trusted], other[target == 0]])
        # some clean windows are read once more as one of their words again and again, which is no offence either
        again = rng.choice(clean, int(s.repeated * len(chosen)))
        chosen, alone = np.concatenate([chosen, again]), np.arange(len(chosen) + len(again)) >= len(chosen)
        order = rng.permutation(len(chosen))
        chosen, alone = chosen[order], alone[order]
        rate = s.rate * min(1.0, 2 * (1 - epoch / (before + epochs)))  # falls in the second half
        for at in range(0, len(chosen), s.batch):
            part, one = chosen[at : at + s.batch], alone[at : at + s.batch]
            read = index[part]
            read[one] = read[one, rng.integers(0, mask[part[one]].sum(axis=1))][:, None]
            used, local = np.unique(read, return_inverse=True)
            known = np.where(rng.random(len(used)) < s.unread, 0, rows[used])  # some words are read by their characters alone
            y_part = target[owner[part]]
            weight = np.where(y_part > 0, s.toxic_weight, 1.0).astype(np.float32)
            adam(gradients(net, known, grams.take(used), local.reshape(read.shape), mask[part], y_part, weight)[1], rate)
        if epoch + 1 >= before + epochs // 2:
            adam.remember()
    net.w = adam.mean
    return net


def scored(net: Network, rows: np.ndarray, grams: Grams, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The logits of windows; the words' gate inputs are computed in pieces."""
    table = np.empty((2, len(rows), 3 * net.s.states), dtype=np.float32)
    for at in range(0, len(rows), 20_000):
        part = np.arange(at, min(at + 20_000, len(rows)))
        x = np.concatenate([net.w["words"][rows[part]], net.char_vectors(grams.take(part))], axis=1)
        for d in (0, 1):
            table[d, part] = x @ net.w["wx"][d] + net.w["b"][d]
    return np.concatenate([net.logits(table, index[a : a + 1024], mask[a : a + 1024]) for a in range(0, len(index), 1024)])


def best_of(owner: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """The window with the highest score of each of n documents; owner ascends."""
    order = np.lexsort((score, owner))
    return order[np.searchsorted(owner[order], np.arange(n), side="right") - 1]


def windows(ids: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, index (n, window), mask of the windows of documents given as arrays of word ids."""
    begin = [starts(len(x), s.window, s.stride) for x in ids]
    owner = np.repeat(np.arange(len(ids)), [len(b) for b in begin])
    size = np.array([len(x) for x in ids], dtype=np.int32)
    offset = (np.cumsum(size) - size).astype(np.int32)
    flat = np.concatenate([*ids, np.zeros(1, dtype=np.int32)]).astype(np.int32)
    inside = np.concatenate(begin).astype(np.int32)[:, None] + np.arange(s.window, dtype=np.int32)
    mask = inside < size[owner][:, None]
    return owner, np.where(mask, flat[np.minimum(offset[owner][:, None] + inside, np.int32(len(flat) - 1))], np.int32(0)), mask


class Scorer:
    """Scores texts with a network; keeps the gate inputs of the words met so far, within a bound."""

    def __init__(self, net: Network, most: int = 150_000):
        self.net, self.most = net, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((2, 1024, 3 * self.net.s.states), dtype=np.float32)

    def ids(self, docs: list[list[str]]) -> list[np.ndarray]:
        new = set().union(*docs) - self.place.keys()
        if new and len(self.place) + len(new) > self.most:
            self.clear()
            new = set().union(*docs)
        if new:
            words = list(new)
            need = len(self.place) + len(words)
            have = self.table.shape[1]
            if need > have:
                grown = np.zeros((2, max(need, have + have // 2), self.table.shape[2]), dtype=np.float32)
                grown[:, :have] = self.table
                self.table = grown
            self.table[:, len(self.place) : need] = self.net.projected(words)
            self.place |= {w: len(self.place) + i for i, w in enumerate(words)}
        return [np.fromiter(map(self.place.__getitem__, d), dtype=np.int32, count=len(d)) for d in docs]

    def __call__(self, texts: list[str]) -> np.ndarray:
        owner, index, mask = windows(self.ids([words_of(t) for t in texts]), self.net.s)
        best = np.full(len(texts), -np.inf)
        for at in range(0, len(index), 1024):
            np.maximum.at(best, owner[at : at + 1024], self.net.logits(self.table, index[at : at + 1024], mask[at : at + 1024]))
        return np.round(1 / (1 + np.exp(-best)), 5)  # sums differ in their last digits with the rows that share a batch


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """text, toxic: a bounded sample of the labelled rows that are not held out, chosen by a hash of the id."""
    open_rows = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    by_hash = F.xxhash64("doc_id")
    chosen = open_rows.where("toxic = 1").orderBy(by_hash).limit(s.sample_toxic).unionByName(open_rows.where("toxic = 0").orderBy(by_hash).limit(s.sample_clean))
    # at most sample_toxic + sample_clean rows of two numbers
    return docs.select("doc_id", "text").where(F.char_length("text") <= s.sample_chars).join(F.broadcast(chosen), "doc_id").orderBy(by_hash, "text").limit(2 * (s.sample_toxic + s.sample_clean)).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Network | float:  # noqa: B008
    rows = training_rows(docs, labels, s).toArrow()
    return fit(rows["text"].to_pylist(), rows["toxic"].to_pylist(), s)


def scored_batches(batches: Iterator[pa.RecordBatch], model: Network | float, chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the scores of their column ``text``; a slice has about so many code points, and one row at least."""
    scorer = model if isinstance(model, float) else Scorer(model)
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        begun, size = 0, 0
        for at, text in enumerate(texts):
            size += len(text)
            if size > chars or at + 1 == len(texts):
                part = texts[begun : at + 1]
                yield batch.slice(begun, len(part)), np.full(len(part), scorer) if isinstance(scorer, float) else scorer(part)
                begun, size = at + 1, 0


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, score of each row.

    A null text counts as empty: one window without words. Every window of a text is
    scored. Rows are independent, so repeated rows and null ids need no rule; an empty
    table gives no rows. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in scored_batches(batches, held.value):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(scores, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Network | float, threshold: float) -> DataFrame:
    """The rows of docs whose score is under the threshold, as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in scored_batches(batches, held.value):
            yield part.filter(pa.array(values < threshold))

    return docs.mapInArrow(kept, docs.schema)
