"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Every whole text is cut into overlapping windows of WINDOW words, STRIDE apart.
A word enters as the embedding of the word itself, where the training sample knows it,
beside the mean embedding of its character trigrams. Two recurrent passes, one
in each direction, run over a window; attention pools their states; the text's
score is that of its most toxic window. All of it is numpy: training on a
bounded, documented sample of the labelled rows (each epoch takes the highest
windows of every sampled text), scoring in Spark tasks.

Since a word's input to the gates does not depend on its neighbours, a task computes it
once for each distinct word.

Defined results: a null, empty or blank text is one window of padding; equal
texts get equal scores; labels that are null, conflicting (the larger
counts) or of an unknown document are no error; without labelled rows of both
kinds every score is 0; repeated rows are scored each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import beside_row, slices

WINDOW, STRIDE = 64, 56
#: The sample of labelled rows: documents of either label, the first by a hash of their id, of at most so many characters.
TRAIN_DOCS, TRAIN_CHARS = 800, 12_000
EPOCHS, SEED = 10, 20_240_607
#: The score that separates the labels, halfway between the sampled clean texts' upper and the toxic texts' lower tail.
THRESHOLD, TAIL = 0.3, 0.01
#: Windows of a sampled text that an epoch learns from, the highest first.
TOP_WINDOWS = 2
#: A word has an embedding of its own from so many sampled texts on.
MIN_TEXTS = 4
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_SLOTS, ATTEND = 8, 8, 8, 1_024, 8
KNOWN_WORDS = 120_000
_EDGE = ".,;:!?\"'()[]«»„“”"


def words_of(text: str | None) -> list[str]:
    return [w.strip(_EDGE) for w in (text or "").lower().split()]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character trigrams of all words, one after the other, and how many each word has.

    A word stands between two marks, so that the empty word has one (of a mark twice).
    """
    marked = "\n" + "".join([f"\x02{w}\x03\x03" if not w else f"\x02{w}\x03" for w in words])
    code = np.frombuffer(marked.encode("utf-32-le", errors="replace"), np.uint32)[1:].astype(np.uint64)
    size = np.array([max(1, len(w)) for w in words], np.int64)
    ends = np.cumsum(size + 2)
    inside = np.ones(len(code), bool)
    inside[ends - 1] = inside[ends - 2] = False
    first = np.flatnonzero(inside)
    mixed = (code[first] * np.uint64(0x9E3779B1) + code[first + 1] * np.uint64(0x85EBCA77) + code[first + 2] * np.uint64(0xC2B2AE3D))
    return ((mixed ^ (mixed >> np.uint64(15))) % np.uint64(CHAR_SLOTS)).astype(np.int64), size


def windows(ids: np.ndarray) -> np.ndarray:
    """Rows of WINDOW numbers, padded with 0; every number stands in a window, most in two."""
    n = len(ids)
    starts = np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)
    padded = np.zeros(int(starts[-1]) + WINDOW, np.int64)
    padded[:n] = ids
    return padded[starts[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters by name, forward and backward passes. Word 0 is unknown to the vocabulary."""

    def __init__(self, vocabulary: dict[str, int], seed: int = SEED):
        self.vocabulary = vocabulary
        rng = np.random.default_rng(seed)
        h, x = HIDDEN, WORD_DIM + CHAR_DIM

        def some(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": some(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": some(CHAR_SLOTS, CHAR_DIM, scale=0.1),
            "into": some(x, 6 * h, scale=x**-0.5), "bias": np.zeros(6 * h, np.float32),
            "fore": some(h, 3 * h, scale=h**-0.5), "back": some(h, 3 * h, scale=h**-0.5),
            "att": some(2 * h, ATTEND, scale=(2 * h) ** -0.5), "att_bias": np.zeros(ATTEND, np.float32),
            "query": some(ATTEND, scale=ATTEND**-0.5), "out": some(2 * h, scale=(2 * h) ** -0.5),
            "out_bias": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary number, and trigram slots with the word each belongs to, and their counts."""
        grams, size = trigrams(words)
        own = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        return own, grams, np.repeat(np.arange(len(words)), size), size

    def gates(self, inputs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's input to the gates of both directions; and the embedding it comes from."""
        word, gram, _, size = inputs
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        chars = np.add.reduceat(self.p["char"][gram], starts, axis=0) / size[:, None].astype(np.float32)
        x = np.concatenate([self.p["word"][word], chars], 1)
        return x @ self.p["into"] + self.p["bias"], x

    def forward(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logit of each window. ``gates``: a row per word; ``index``: windows of rows + 1, 0 for padding."""
        h, n, steps = HIDDEN, len(index), index.shape[1]
        mask = (index > 0).astype(np.float32)
        mask[:, 0] = 1  # a window without words is one padding step
        padded = np.concatenate([np.zeros((1, 6 * h), np.float32), gates])
        states = np.empty((steps, n, 2 * h), np.float32)
        trace: list[list] = [[], []]
        for side, (name, order) in enumerate((("fore", range(steps)), ("back", range(steps - 1, -1, -1)))):
            u, s = self.p[name], np.zeros((n, h), np.float32)
            own = np.ascontiguousarray(padded[:, 3 * h * side : 3 * h * (side + 1)])
            for t in order:
                g, r = own[index[:, t]], s @ u
                zr = _sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                z, reset = zr[:, :h], zr[:, h:]
                new = np.tanh(g[:, 2 * h :] + reset * r[:, 2 * h :])
                if keep:
                    trace[side].append((t, s, z, reset, new, r[:, 2 * h :]))
                s = (new + z * (s - new)) * mask[:, t, None]
                states[t, :, side * h : side * h + h] = s
        att = np.tanh(states @ self.p["att"] + self.p["att_bias"])
        e = att @ self.p["query"] + (mask.T - 1) * 1e4
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        logit = pooled @ self.p["out"] + self.p["out_bias"][0]
        return (logit, (mask, states, trace, att, alpha, pooled)) if keep else logit

    def gradients(self, inputs: tuple[np.ndarray, ...], index: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean log loss of the windows and its gradient by parameter."""
        h = HIDDEN
        gates, x = self.gates(inputs)
        logit, (mask, states, trace, att, alpha, pooled) = self.forward(gates, index, keep=True)
        p = _sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - target * logit)).sum() / weight.sum())
        d = {k: np.zeros_like(v) for k, v in self.p.items()}
        dl = (weight * (p - target) / weight.sum()).astype(np.float32)
        d["out"], d["out_bias"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpool = dl[:, None] * self.p["out"]
        dstates = alpha[:, :, None] * dpool[None]
        dalpha = np.einsum("tnh,nh->tn", states, dpool)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        d["query"] = np.einsum("tn,tna->a", de, att)
        datt = de[:, :, None] * self.p["query"] * (1 - att * att)
        d["att"], d["att_bias"] = np.einsum("tnh,tna->ha", states, datt), datt.sum((0, 1))
        dstates += datt @ self.p["att"].T
        dgates = np.zeros((len(gates) + 1, 6 * h), np.float32)
        for side, name in enumerate(("fore", "back")):
            u, ds = self.p[name], np.zeros((len(index), h), np.float32)
            for t, s, z, reset, new, rn in reversed(trace[side]):
                ds = (ds + dstates[t, :, side * h : side * h + h]) * mask[:, t, None]
                dnew = ds * (1 - z) * (1 - new * new)
                dz = ds * (s - new) * z * (1 - z)
                dreset = dnew * rn * reset * (1 - reset)
                dr = np.concatenate([dz, dreset, dnew * reset], 1)
                np.add.at(dgates[:, 3 * h * side : 3 * h * (side + 1)], index[:, t], np.concatenate([dz, dreset, dnew], 1))
                d[name] += s.T @ dr
                ds = ds * z + dr @ u.T
        dgates = dgates[1:]
        d["into"], d["bias"] = x.T @ dgates, dgates.sum(0)
        dx = dgates @ self.p["into"].T
        word, gram, owner, size = inputs
        np.add.at(d["word"], word, dx[:, :WORD_DIM])
        d["word"][0] = 0  # an unknown word is its characters alone
        np.add.at(d["char"], gram, (dx[:, WORD_DIM:] / size[:, None])[owner])
        return loss, d


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """The network trained on whole texts; None unless both labels occur."""
    if len(set(labels)) < 2:
        return None
    split = [words_of(t) for t in texts]
    y = np.array(labels, np.float32)
    held = Counter(w for s in split for w in set(s))
    positive = Counter(w for s, label in zip(split, labels, strict=True) if label for w in set(s))
    vocabulary = {w: k for k, w in enumerate(sorted(w for w, n in held.items() if n >= MIN_TEXTS), 1)}
    net = Network(vocabulary, seed)
    # One component of a word's embedding starts at its smoothed log odds.
    ones, zeros = y.sum(), len(y) - y.sum()
    for w, k in vocabulary.items():
        a, b = positive[w], held[w] - positive[w]
        net.p["word"][k, 0] = 0.5 * np.log(((a + 1) / (ones + 2)) / ((b + 1) / (zeros + 2)))
    names = {w: k for k, w in enumerate(sorted(held))}
    inputs = net.inputs(list(names))
    index = [windows(np.array([names[w] + 1 for w in s], np.int64)) for s in split]
    owner, every = np.repeat(np.arange(len(index)), [len(i) for i in index]), np.concatenate(index)
    balance = np.where(y == 1, 0.5 / ones, 0.5 / zeros).astype(np.float32) * len(y)
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        gates, _ = net.gates(inputs)
        logit = np.concatenate([net.forward(gates, every[a : a + 4096]) for a in range(0, len(every), 4096)])
        order = np.lexsort((-logit, owner))
        first = np.concatenate([[0], np.flatnonzero(np.diff(owner[order])) + 1])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
        # A toxic text needs one toxic window; a clean text has none.
        chosen = order[(rank == 0) | ((rank < TOP_WINDOWS) & (y[owner[order]] == 0))]
        chosen = rng.permutation(chosen)
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for a in range(0, len(chosen), 192):
            own = chosen[a : a + 192]
            used, at = np.unique(every[own], return_inverse=True)
            at, rows = at.reshape(len(own), -1), used[used > 0] - 1
            at = at if used[0] == 0 else at + 1
            word, gram, gram_owner, size = inputs
            begin = np.concatenate([[0], np.cumsum(size)])
            grams = np.concatenate([gram[begin[r] : begin[r + 1]] for r in rows]) if len(rows) else np.zeros(0, np.int64)
            few = (word[rows], grams, np.repeat(np.arange(len(rows)), size[rows]), size[rows])
            _, d = net.gradients(few, at, y[owner[own]], balance[owner[own]])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in d.values()))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            for k, g in d.items():
                g = g * clip
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    gates, _ = net.gates(inputs)
    logit = np.concatenate([net.forward(gates, every[a : a + 4096]) for a in range(0, len(every), 4096)])
    top = np.maximum.reduceat(logit, np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1]))
    halfway = (np.quantile(top[y == 0], 1 - TAIL) + np.quantile(top[y == 1], TAIL)) / 2
    net.p["out_bias"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - halfway)
    return net


class Scorer:
    """Scores texts; keeps the gate inputs of words it has met, KNOWN_WORDS at most."""

    def __init__(self, net: Network):
        self.net = net
        self.known: dict[str, int] = {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known, self.gates = {}, self.gates[:0]
        new = list(set().union(*split).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known) + 1, len(self.known) + len(new) + 1), strict=True))
            parts = [self.net.gates(self.net.inputs(new[a : a + 20_000]))[0] for a in range(0, len(new), 20_000)]
            self.gates = np.concatenate([self.gates, *parts])
        get = self.known.__getitem__
        index = [windows(np.array(list(map(get, s)), np.int64)) for s in split]
        first = np.concatenate([[0], np.cumsum([len(i) for i in index])[:-1]])
        every = np.concatenate(index)
        logit = np.concatenate([self.net.forward(self.gates, every[a : a + 2048]) for a in range(0, len(every), 2048)])
        return _sigmoid(np.maximum.reduceat(logit, first).astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Network | None:
    """Network from at most ``train_docs`` documents of either label. ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids: list[int] = []
    for value in (0, 1):
        some = marked.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * train_docs)
        ids += [r[0] for r in some.select("doc_id").collect()]
    if not ids:
        return None
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(
        F.col("doc_id").isin(ids) & F.length("text").between(1, max_chars))
    both = texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(marked.filter(F.col("doc_id").isin(ids)), "doc_id")
    sample: list[tuple[str, int]] = []
    for value in (0, 1):
        rows = both.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).select("text").toArrow()
        sample += [(t, value) for t in rows["text"].to_pylist()]
    return fit([t for t, _ in sample], [v for _, v in sample])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """row (struct of the input's columns) and score of every whole text."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    if net is None:
        return rows.select("row", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the sample

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.score(part.column(1).to_pylist()))],
                                             names=["row", "score"])

    return rows.mapInArrow(judge, beside_row(rows, "score double"))
