"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (``window`` consecutive words; an item of fewer words is one
window) is a set of ``shingle``-word shingles. Shingles are ordered by rarity, counted
over all documents. A window can only be contained in a stretch of a document if one of
its rarest shingles is: with s shingles of which ceil(containment * s) must occur,
one of the first s - ceil(containment * s) + 1. Only these, the window's prefix, are
joined with the documents; the length bound drops windows longer than the document, the positional bound those
that would begin before it or end behind it. What remains is verified on the words
themselves, over stretches of the document as long as the window.

``containment`` 1 means the window's words in its order; below 1, the share of its shingles
that a stretch of its length holds.

Two passes read the documents: one counts the items' shingles, one finds prefix shingles with
the words around them. Both look a shingle up in a bitmap of at most 2^27 bits, whatever the
number of items: with few items nearly nothing else passes, with very many items more rows
pass; the joins that follow are exact either way. Windows that are equal are one, however
many items hold them. The words hit are counted as bits of 64-word blocks, so a passage
in very many documents is no large group anywhere.

Defined results: a null, empty or wordless text has no words and no hits; an item
without words has no window; a null item id is the empty string; items with one id are one item;
repeated documents are judged each; empty tables give no rows, or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import list_digests, slices
from faultline.operators.skew import one_per_key
from faultline.storage import materialize

WINDOW, SHINGLE = 10, 5
#: Bits of the bitmap per shingle, and its size as powers of two.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 256, 22, 27
EMITTED = 20_000
_M = np.uint64(0x9E3779B97F4A7C15)
_SEPARATORS = [b for b in range(0x80) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]
_TABLE = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters A-Z (lower-cased), digits and characters from U+0080 on."""
    return (text or "").encode(errors="replace").translate(_TABLE).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _rolled(hashed: np.ndarray, size: int) -> np.ndarray:
    """One number for each run of ``size`` words; the size is part of it."""
    n = max(0, len(hashed) - size + 1)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = (out ^ hashed[k : k + n]) * _M
        out ^= out >> np.uint64(29)
    return out


class Bitmap:
    """Numbers that may occur; false ones pass at a rate of at most one in BITS_PER_KEY, or more once the bits are at their most."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.shift = np.uint64(64 - bits)
        self.data = np.zeros(1 << (bits - 3), np.uint8)
        for block, held in blocks.items():
            self.data[block * 4096 : (block + 1) * 4096] = np.frombuffer(held, np.uint8)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        slot = numbers >> self.shift
        return (self.data[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame) -> Bitmap:
    """Of the column ``key`` (long) of ``keys``, distinct."""
    count = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_KEY * max(1, count) - 1).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - bits)
    # 32,768 bits to a block: the list of a block is bounded, whatever the number of keys.
    lists = keys.select(F.shiftrightunsigned(slot, 15).alias("block"), slot.bitwiseAND(32_767).cast("int").alias("bit"))
    lists = lists.groupBy("block").agg(F.collect_set("bit").alias("bits"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for held in batch.column(1).to_pylist():
                marks = np.zeros(32_768, np.uint8)
                marks[held] = 1
                out.append(np.packbits(marks, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "held"])

    rows = lists.mapInArrow(pack, "block long, held binary").collect()  # at most 2^27 bits together
    return Bitmap(bits, {r.block: bytes(r.held) for r in rows})


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (as string), wid, words (joined), size: the distinct windows of every item."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for name, text in zip(*(part.column(i).to_pylist() for i in (0, 1)), strict=True):
                words = words_of(text)
                if not words:
                    continue
                size = min(window, len(words))
                held = sorted({b" ".join(words[a : a + size]).decode(errors="replace") for a in range(len(words) - size + 1)})
                for a in range(0, len(held), EMITTED):
                    some = held[a : a + EMITTED]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(some), pa.string()), pa.array(some, pa.string()), pa.array([size] * len(some), pa.int64())],
                        names=["item_id", "words", "size"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string"))
    found = rows.mapInArrow(cut, "item_id string, words string, size long")
    return found.select("item_id", F.unhex(F.md5("words")).alias("wid"), "words", "size").distinct()


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """wid, words, size, key, start: each distinct shingle of each distinct window, and where it first stands."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at, keys, starts = [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                words = text.encode().split()
                key, first = np.unique(_rolled(_hashes(words), min(shingle, len(words))), return_index=True)
                at += [i] * len(key)
                keys.append(key)
                starts.append(first)
            some = part.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*some.columns, pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(starts), pa.int64())],
                names=["wid", "words", "size", "key", "start"])

    return windows.mapInArrow(cut, "wid binary, words string, size long, key long, start long")


def _sizes(windows: DataFrame, shingle: int) -> list[int]:
    """The shingle lengths in use, at most ``shingle`` of them."""
    return sorted(r[0] for r in windows.select(F.least("size", F.lit(shingle))).distinct().collect())


def _counts(docs: DataFrame, keys: Bitmap, sizes: list[int]) -> DataFrame:
    """key, n: how often the shingles of the bitmap occur in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = sent.value, []
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                hashed = _hashes(words_of(text))
                for size in sizes:
                    rolled = _rolled(hashed, size)
                    held.append(rolled[known.has(rolled)])
            if sum(map(len, held)) >= EMITTED:
                yield _counted(held)
                held = []
        if held:
            yield _counted(held)

    def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def rarest(windows: DataFrame, docs: DataFrame, shingle: int = SHINGLE, containment: float = 1.0) -> DataFrame:
    """The prefix of every window: wid, words, size, key, start, of its rarest shingles in ``docs``, as many as needed."""
    shingles = materialize(_window_shingles(windows, shingle), "shingles")
    keys = shingles.select("key").distinct()
    counted = _counts(docs, bitmap(keys), _sizes(windows, shingle))
    counts = one_per_key(materialize(keys.join(counted, "key", "left").fillna(0, ["n"]), "rarity"), "key")
    entry = F.struct("n", "key", "start")
    # At most ``window`` shingles a window.
    ordered = shingles.join(counts, "key").groupBy("wid", "words", "size").agg(F.sort_array(F.collect_list(entry)).alias("order"))
    s = F.size("order")
    take = s - F.ceil(s * F.lit(containment) - F.lit(1e-9)).cast("int") + 1
    return ordered.select("wid", "words", "size", F.explode(F.slice("order", F.lit(1), take)).alias("e")).select(
        "wid", "words", "size", "e.key", "e.start")


def _scan(docs: DataFrame, keys: Bitmap, sizes: list[int], around: int) -> DataFrame:
    """A row for each document (key null) and for each prefix shingle in it, with the words ``around`` it."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)
    names = ["uid", "doc_id", "n_words", "key", "at", "before", "context"]

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for part in slices(batches):
            rows: list[tuple] = []
            for uid, doc, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                rows.append((uid, doc, len(words), None, None, None, None))
                hashed = _hashes(words)
                for size in sizes:
                    rolled = _rolled(hashed, size)
                    some = np.flatnonzero(known.has(rolled))
                    for at, key in zip(some.tolist(), rolled[some].view(np.int64).tolist(), strict=True):
                        low = max(0, at - around)
                        rows.append((uid, doc, len(words), key, at, at - low,
                                     b" ".join(words[low : at + size + around]).decode(errors="replace")))
                        if len(rows) >= EMITTED:
                            yield out(rows)
                            rows = []
            if rows:
                yield out(rows)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(find, "uid long, doc_id long, n_words long, key long, at long, before long, context string")


def _verify(candidates: DataFrame, shingle: int, containment: float) -> DataFrame:
    """uid, wid, begin, size of the stretches that hold their window."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at, begins = [], []
            columns = (part.column(i).to_pylist() for i in range(3, 8))
            for i, (size, start, place, before, both) in enumerate(zip(*columns, strict=True)):
                words, context = both["words"].split(" "), both["context"].split(" ")
                if containment == 1:
                    low = before - start
                    if context[low : low + size] == words:
                        at.append(i)
                        begins.append(place - start)
                    continue
                k = min(shingle, size)
                wanted = {tuple(words[a : a + k]) for a in range(size - k + 1)}
                need = ceil(containment * len(wanted) - 1e-9)
                own = [tuple(context[a : a + k]) for a in range(len(context) - k + 1)]
                for low in range(max(0, before - size + k), min(before, len(context) - size) + 1):
                    if len(wanted.intersection(own[low : low + size - k + 1])) >= need:
                        at.append(i)
                        begins.append(place - before + low)
            some = part.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(begins, pa.int64()), some.column(3)],
                                             names=["uid", "wid", "begin", "size"])

    rows = candidates.select("uid", "wid", "key", "size", "start", "at", "before", F.struct("words", "context").alias("both"))
    return rows.mapInArrow(verify, "uid long, wid binary, begin long, size long").distinct()


class Contamination:
    """What ``find`` found, as tables: ``documents`` (uid, doc_id, n_words), ``spans`` (uid, wid, begin, size: words), ``windows`` (item_id, wid, words, size)."""

    def __init__(self, documents: DataFrame, spans: DataFrame, windows: DataFrame):
        self.documents, self.spans, self.windows = documents, spans, windows

    def items(self) -> DataFrame:
        """uid, item_id: the items that have a window in a document."""
        held = self.spans.select("uid", "wid").distinct()
        return held.join(self.windows.select("wid", "item_id"), "wid").select("uid", "item_id").distinct()

    def words_hit(self) -> DataFrame:
        """uid, n_hit: words inside any span."""
        low = F.col("begin") % 64
        bits = F.expr("case when size >= 64 then -1L else shiftleft(1L, cast(size as int)) - 1 end")
        here = F.struct((F.col("begin") - low).alias("block"), F.call_function("shiftleft", bits, low.cast("int")).alias("mask"))
        rest = F.struct((F.col("begin") - low + 64).alias("block"),
                        F.call_function("shiftrightunsigned", bits, (64 - low).cast("int")).alias("mask"))
        both = F.when(low + F.col("size") > 64, F.array(here, rest)).otherwise(F.array(here))
        blocks = self.spans.select("uid", F.explode(both).alias("b")).groupBy("uid", "b.block").agg(F.bit_or("b.mask").alias("mask"))
        return blocks.groupBy("uid").agg(F.sum(F.bit_count("mask")).alias("n_hit"))

    def report(self) -> DataFrame:
        """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined item ids), contaminated, for every document."""
        lists = list_digests(self.items(), "uid", "item_id").withColumnRenamed("n", "n_items").withColumnRenamed("sha256", "items_sha256")
        out = self.documents.join(self.words_hit(), "uid", "left").join(lists, "uid", "left")
        hit = F.coalesce("n_hit", F.lit(0)).cast("long")
        return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                          F.coalesce("items_sha256", F.lit(EMPTY_SHA256)).alias("items_sha256"), (hit > 0).alias("contaminated"))


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
         containment: float = 1.0) -> Contamination:
    """The windows of ``items`` (item_id, text) in ``docs`` (doc_id, text). ``window``: 64 words at most."""
    if not 1 <= window <= 64 or not 0 < containment <= 1:
        raise ValueError("window: 1 to 64 words; containment: above 0, at most 1")
    pairs = materialize(item_windows(items, window), "item_windows")
    windows = materialize(pairs.select("wid", "words", "size").distinct(), "windows")
    prefixes = materialize(rarest(windows, docs, shingle, containment), "prefixes")
    sizes = _sizes(windows, shingle)
    found = materialize(_scan(docs, bitmap(prefixes.select("key").distinct()), sizes, window), "scan")
    hits = found.filter("key is not null").select("uid", "n_words", "key", "at", "before", "context")
    candidates = hits.join(prefixes, "key").filter("size <= n_words")
    if containment == 1:
        candidates = candidates.filter("at >= start and at - start + size <= n_words")
    spans = materialize(_verify(candidates, shingle, containment), "spans")
    return Contamination(found.filter("key is null").select("uid", "doc_id", "n_words"), spans, pairs)
