"""Language identification by prediction by partial matching.

Per language a variable-order byte context tree (orders 0 to ORDER) is counted
by Spark over a bounded, documented sample of the labelled rows and then
frozen. A byte is coded in its longest known context; where the context does
not know the byte, the escape (method C: distinct successors over total plus
distinct) is paid and the next shorter context tried, down to uniform bytes.
The language with the shortest exact code length of the whole text wins.

The trees of all languages share one hash table per order, with a row of code
lengths (one per language) for each known context and byte, resolved through
the escapes; so a text costs one lookup a byte, and more only where it escapes.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text where nothing could be learned; equal code lengths go to
the first language by name; repeated rows are scored alike; rows with a null or
empty ``lang`` teach nothing; a null id is scored like any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import beside_row, slices

#: Bytes of context at most.
ORDER = 4
#: The sample of labelled rows: documents per language, of at most so many characters.
TRAIN_DOCS = 150
TRAIN_CHARS = 20_000
#: Bytes whose evidence counts in full for the score; more bytes do not raise it further.
EVIDENCE_BYTES = 64
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def _rolling(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of all texts: itself and the ``order`` bytes before it as one number; the starts of the texts.

    Each text starts after ``order`` zero bytes.
    """
    pad = bytes(order)
    data = np.frombuffer(pad + pad.join(texts), np.uint8) if texts else np.zeros(order, np.uint8)
    keys = np.zeros(len(data) - order, np.uint64)
    for k in range(order + 1):
        keys = (keys << np.uint64(8)) | data[k : len(data) - order + k]
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths[:-1] + order)]).astype(np.int64) if texts else np.zeros(0, np.int64)
    return keys, begin


def count_contexts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, size (bytes of context and successor), key, n: summed over all rows of ``docs`` (lang, text)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.lower().encode())
            for lang, texts in by.items():
                keys, begin = _rolling(texts, order)
                inside = np.concatenate([np.arange(b, b + len(t)) for b, t in zip(begin, texts, strict=True)])
                for size in range(1, order + 2):
                    mask = np.uint64((1 << 8 * size) - 1)
                    found, n = np.unique(keys[inside] & mask, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found)), pa.array(np.full(len(found), size, np.int32)),
                         pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "size", "key", "n"])

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, size int, key long, n long")
    return counted.groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


class HashTable:
    """Numbers to rows, by open addressing; a slot holds a number plus one, or zero."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at[left]] == 0
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.slots[at[put]], self.rows[at[put]] = keys[put] + np.uint64(1), put
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each number, -1 where it is unknown."""
        at = self._slot(keys)
        got = self.slots[at]
        rows = np.where(got == keys + np.uint64(1), self.rows[at], -1)
        left = np.flatnonzero((rows < 0) & (got != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            got, want = self.slots[at[left]], keys[left] + np.uint64(1)
            hit = got == want
            rows[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (got != 0)]
        return rows


class Trees:
    """The frozen context trees of all languages."""

    def __init__(self, langs: list[str], counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.langs, self.order = langs, order
        self.known: list[HashTable] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[HashTable] = []
        self.escape: list[np.ndarray] = []
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for size in range(1, order + 2):
            each = [counts.get((lang, size), empty) for lang in langs]
            keys = np.unique(np.concatenate([empty[0], *(k for k, _ in each)]))
            contexts = np.unique(keys >> np.uint64(8))
            escape = np.zeros((len(contexts), len(langs)), np.float64)
            totals = []
            for j, (k, n) in enumerate(each):
                at = np.searchsorted(contexts, k >> np.uint64(8))
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                seen = kinds > 0
                escape[seen, j] = np.log2((total[seen] + kinds[seen]) / kinds[seen])
                totals.append(total + kinds)
            self.contexts.append(HashTable(contexts))
            self.escape.append(escape)
            cost = self._shorter(keys, size) + escape[np.searchsorted(contexts, keys >> np.uint64(8))]
            for j, (k, n) in enumerate(each):
                cost[np.searchsorted(keys, k), j] = np.log2(
                    totals[j][np.searchsorted(contexts, k >> np.uint64(8))] / n)
            self.known.append(HashTable(keys))
            self.cost.append(cost)

    def _shorter(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Code length without the first byte of context."""
        if size == 1:
            return np.full((len(keys), len(self.langs)), 8.0)
        return self.code(keys & np.uint64((1 << 8 * (size - 1)) - 1), size - 1)

    def code(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Bits of the last byte of each number after the bytes before it, per language."""
        rows = self.known[size - 1].find(keys)
        out = self.cost[size - 1][rows]
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            rest = keys[miss]
            at = self.contexts[size - 1].find(rest >> np.uint64(8))
            out[miss] = np.where((at >= 0)[:, None], self.escape[size - 1][at], 0.0) + self._shorter(rest, size)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text, per language."""
        out = np.zeros((len(texts), len(self.langs)))
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        keys, begin = _rolling([texts[i] for i in some], self.order)
        bits = np.concatenate([self.code(keys[a : a + 65_536], self.order + 1) for a in range(0, len(keys), 65_536)])
        size = np.array([len(texts[i]) for i in some])
        edges = np.stack([begin, begin + size], 1).ravel()
        sums = np.add.reduceat(np.concatenate([bits, np.zeros((1, bits.shape[1]))]), edges, axis=0)[::2]
        out[some] = sums
        return out


def train(labelled: DataFrame, order: int = ORDER, docs_per_language: int = TRAIN_DOCS,
          max_chars: int = TRAIN_CHARS) -> Trees:
    """Trees of a sample of ``labelled`` (doc_id, text, lang): the first documents of each language by a hash of their id."""
    rows = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.filter("lang is not null and lang <> '' and text is not null and doc_id is not null"
                       f" and length(text) between 1 and {int(max_chars)}")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (rows.select("lang", "doc_id").withColumn("k", F.row_number().over(first))
              .filter(F.col("k") <= docs_per_language).select("doc_id").distinct())
    ids = [r[0] for r in chosen.collect()]  # docs_per_language times the languages at most
    if not ids:
        return Trees([], {}, order)
    sample = rows.filter(F.col("doc_id").isin(ids)).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    counted = count_contexts(sample, order).toArrow()
    lang, size = np.array(counted["lang"].to_pylist(), object), counted["size"].to_numpy()
    key, n = counted["key"].to_numpy().astype(np.uint64), counted["n"].to_numpy()
    counts, langs = {}, sorted(set(lang))
    for name in langs:
        for s in range(1, order + 2):
            at = (lang == name) & (size == s)
            by = np.argsort(key[at])
            counts[name, s] = key[at][by], n[at][by]
    return Trees(langs, counts, order)


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """row (struct of the input's columns), lang_pred, score and bits_per_byte of every text."""
    model = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample: see TRAIN_DOCS, TRAIN_CHARS
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            code = [t.lower().encode(errors="replace") if t and trees.langs and has_letter(t) else b"" for t in texts]
            langs, scores, rate = [], [], []
            for b, t in zip(trees.lengths(code), code, strict=True):
                if not t:
                    langs.append(UND)
                    scores.append(0.0)
                    rate.append(None)
                    continue
                best = int(b.argmin())
                near = np.exp2(-(b - b[best]) * min(1.0, EVIDENCE_BYTES / len(t)))
                langs.append(trees.langs[best])
                scores.append(float(1 / near.sum()))
                rate.append(float(b[best] / len(t)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rate, pa.float64())],
                names=["row", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(judge, beside_row(rows, "lang_pred string, score double, bits_per_byte double"))
