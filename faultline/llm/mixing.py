"""Mixing to target weights over soft domain memberships.

A multinomial classifier, trained in numpy on a bounded sample of the labelled
rows, gives every document a posterior over domains. A document of t tokens
and posterior p, taken at rate r, contributes r * t * p_k expected tokens to
domain k. The rates solve

    min over 0 <= r <= max_rate of  e^T G^-1 e / (2 N),  e_k = sum_i r_i t_i p_ik - T_k

(N: all tokens; G: the domains' second moments, sum_i t_i p_i p_i^T / N) by scaled projected gradient steps from r = 1:
r <- clip(r - a p^T H^-1 e / N), H the second moments of the documents that a step can still move. So a step meets
the targets at once as long as no rate meets a bound, and reachable targets are met within TOLERANCE. A step takes
two sums over all documents, which Spark gathers: H, and e for several lengths a at a time, of which the best is taken; a rate is
a fold over the few steps, so no step rewrites the documents and lineage stays flat.
Targets out of reach are approached until a step brings less than LEAST_GAIN.

``copies`` turns a rate into whole copies: its integer part, plus one where a
hash of the document falls below the rest.

Defined results: a null or empty text has no tokens, the posterior of its
(empty) features and rate 1; repeated rows get the same rate; labels
that are null, or of an unknown document, teach nothing; without any labelled
row every posterior is uniform; an empty table gives no rows; a null id is
hashed like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import beside_row, slices
from faultline.storage import materialize

#: The sample of labelled rows: so many documents, the first by a hash of their id, of at most so many characters.
TRAIN_DOCS = 4_000
TRAIN_CHARS = 20_000
WORD_SLOTS = 2_048
KNOWN_WORDS = 400_000
#: Steps of the solver at most; the error, relative to each target, at which it stops; the least relative gain of a step; its lengths.
STEPS, TOLERANCE, LEAST_GAIN, LENGTHS = 20, 1e-4, 0.01, (1.0, 0.5, 0.25, 0.125)

#: Domains of the `labels` table.
DOMAINS = ("good", "low", "toxic")


def label_domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when((quality == 1) & (toxic == 0), "good").when(
        (quality == 0) & (toxic == 0), "low")


_SHAPES = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!?.,;:", b"#*$%&|<>@{}[]_=+~^/\\", bytes(range(128, 256))]
_ALL = bytes(range(256))
_DELETE = [bytes(b for b in _ALL if b not in s) for s in _SHAPES]


class Features:
    """Words hashed to slots, and a few shapes of the text, of whole texts."""

    dense = len(_SHAPES) + 3

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _slot(self, word: bytes) -> int:
        self.known[word] = slot = xxhash.xxh32_intdigest(word.strip(b".,;:!?\"'()").lower()) % WORD_SLOTS
        return slot

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Slot of each word, the shapes, and the number of words."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        data = text.encode(errors="replace")
        words = data.split()
        n = len(words)
        get = self.known.get
        slots = np.array([s if (s := get(w)) is not None else self._slot(w) for w in words], np.int64)
        size = max(1, len(data))
        shape = [len(data.translate(None, d)) / size for d in _DELETE]
        shape += [len(set(words)) / max(1, n), np.log1p(n) / 10, len(data) / max(1, n) / 50]
        return slots, np.array(shape), n


@dataclass
class Classifier:
    domains: tuple[str, ...]
    words: np.ndarray  # (WORD_SLOTS, K)
    shapes: np.ndarray  # (dense, K)
    bias: np.ndarray

    def logits(self, slots: np.ndarray, shape: np.ndarray) -> np.ndarray:
        mean = self.words[slots].sum(0) / np.sqrt(max(1, len(slots))) if len(slots) else 0.0
        return mean + shape @ self.shapes + self.bias


def fit(sample: list[tuple[str, str]], domains: tuple[str, ...], steps: int = 250, decay: float = 1e-4) -> Classifier:
    """Softmax regression by Adam, on (text, domain) pairs."""
    k = len(domains)
    model = Classifier(domains, np.zeros((WORD_SLOTS, k)), np.zeros((Features.dense, k)), np.zeros(k))
    if not sample:
        return model
    features = Features()
    x = np.zeros((len(sample), WORD_SLOTS + Features.dense + 1), np.float32)
    for i, (text, _) in enumerate(sample):
        slots, shape, n = features.of(text)
        x[i, :WORD_SLOTS] = np.bincount(slots, minlength=WORD_SLOTS) / np.sqrt(max(1, n))
        x[i, WORD_SLOTS:-1] = shape
        x[i, -1] = 1
    y = np.eye(k, dtype=np.float32)[[domains.index(d) for _, d in sample]]
    w = np.zeros((x.shape[1], k), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - y) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = w.astype(float)
    return Classifier(domains, w[:WORD_SLOTS], w[WORD_SLOTS:-1], w[-1])


def train(docs: DataFrame, labels: DataFrame, domain: Column, domains: tuple[str, ...],
          train_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Classifier:
    """Classifier from the first ``train_docs`` labelled documents by a hash of their id."""
    named = labels.select(F.col("doc_id").cast("long"), domain.alias("domain")).filter("domain is not null and doc_id is not null")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(
        f"doc_id is not null and length(text) between 1 and {int(max_chars)}")
    # Twice the labelled ids needed: some have no text of that length.
    ids = [r[0] for r in named.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * train_docs).collect()]
    if not ids:
        return fit([], domains)
    few = texts.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("text").alias("text"))
    few = few.join(named.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("domain").alias("domain")), "doc_id")
    rows = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).select("text", "domain").toArrow()
    return fit(list(zip(rows["text"].to_pylist(), rows["domain"].to_pylist(), strict=True)), domains)


def memberships(docs: DataFrame, model: Classifier, keep: list[str] | None = None) -> DataFrame:
    """row (struct of the input's columns, or of those to ``keep``), tokens, p (posterior over the domains) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WORD_SLOTS rows
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col("text").cast("string").alias("text"))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), sent.value
        for part in slices(batches):
            z, tokens = [], []
            for text in part.column(1).to_pylist():
                slots, shape, n = features.of(text or "")
                z.append(model.logits(slots, shape))
                tokens.append(n)
            z = np.array(z)
            p = np.exp(z - z.max(1, keepdims=True))
            p = np.round(p / p.sum(1, keepdims=True), 12)  # equal for equal texts, wherever they stand in a batch
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))],
                names=["row", "tokens", "p"])

    return rows.mapInArrow(score, beside_row(rows, "tokens long, p array<double>"))


def rates(p: np.ndarray, steps: list[np.ndarray], max_rate: float) -> np.ndarray:
    """The rates after ``steps``."""
    rate = np.ones(len(p))
    for step in steps:
        rate = np.clip(rate - p @ step, 0, max_rate)
    return rate


def solve(table: DataFrame, targets: np.ndarray, max_rate: float, steps: int = STEPS,
          tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The steps of the scaled projected gradient; ``table``: tokens, p."""
    domains = len(targets)

    def gather(fn: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all documents of what ``fn`` gives for a batch (tokens, p)."""
        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                t = batch.column(0).to_numpy().astype(float)
                total += fn(t, batch.column(1).flatten().to_numpy().reshape(len(t), domains)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["total"])

        part = table.select("tokens", "p").mapInArrow(add, "total array<double>")
        row = part.agg(*[F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(size)]).first()
        return np.array([v or 0.0 for v in row], float)

    def moments(t: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (p * t[:, None]).T @ p

    def scaled(matrix: np.ndarray, e: np.ndarray) -> np.ndarray:
        """matrix^-1 e; a direction without any mass does not move."""
        w, v = np.linalg.eigh(matrix)
        top = w.max(initial=0.0)
        return v @ np.where(w > 1e-9 * top, (v.T @ e) / np.maximum(w, 1e-9 * top + 1e-300), 0.0)

    got = gather(lambda t, p: np.concatenate([t @ p, moments(t, p).ravel()]), domains + domains**2)
    e, gram = got[:domains] - targets, got[domains:].reshape(domains, domains)
    if not got[:domains].sum():
        return []
    least = tolerance * np.maximum(np.abs(targets), 1e-6 * got[:domains].sum())
    taken: list[np.ndarray] = []
    for _ in range(steps):
        if (np.abs(e) <= least).all():
            break
        far = e @ scaled(gram, e)
        slope = scaled(gram, e)

        def movable(t, p, slope=slope, taken=tuple(taken)):
            rate, g = rates(p, taken, max_rate), p @ slope
            free = ((rate > 0) | (g < 0)) & ((rate < max_rate) | (g > 0))
            return moments(t[free], p[free])

        direction = scaled(gather(movable, domains**2).reshape(domains, domains), e)

        def tried(t, p, direction=direction, taken=tuple(taken)):
            return np.stack([(rates(p, [*taken, a * direction], max_rate) * t) @ p for a in LENGTHS])

        ends = gather(tried, len(LENGTHS) * domains).reshape(-1, domains) - targets
        costs = [x @ scaled(gram, x) for x in ends]
        best = int(np.argmin(costs))
        if costs[best] >= far * (1 - LEAST_GAIN):
            break
        taken.append(LENGTHS[best] * direction)
        e = ends[best]
    return taken


def mix(docs: DataFrame, model: Classifier, weights: dict[str, float], max_rate: float | None = None,
        total: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """row, tokens, p, rate, copies for every row of ``docs``.

    ``weights``: share of each domain in the mix. ``total``: its tokens; left
    out, it is as many as ``docs`` has - or, where a rate may not exceed 1, as
    many as the scarcest domain allows when it is taken whole.
    """
    top = float("inf") if max_rate is None else float(max_rate)
    share = np.array([weights[d] for d in model.domains], float)
    share /= share.sum()
    staged = materialize(memberships(docs, model, keep), "memberships")
    sums = staged.agg(*[F.sum(F.col("tokens") * F.col("p")[k]) for k in range(len(share))]).first()
    have = np.array([v or 0.0 for v in sums])
    if total is None:
        filled = have[share > 0] / share[share > 0]
        total = have.sum() if top > 1 else float(filled.min(initial=have.sum()))
    taken = solve(staged, share * total, top)

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(1).to_numpy()
            p = batch.column(2).flatten().to_numpy().reshape(len(t), len(share))
            found = np.where(t > 0, np.round(rates(p, taken, top), 9), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["row", "tokens", "p", "rate"])

    rated = staged.mapInArrow(rate, beside_row(staged, "tokens long, p array<double>, rate double"))
    chance = F.pmod(F.xxhash64("row.doc_id", F.lit(20_240_607)), F.lit(1 << 40)) / float(1 << 40)
    whole = F.floor("rate")
    return rated.withColumn("copies", (whole + F.when(chance < F.col("rate") - whole, 1).otherwise(0)).cast("long"))
