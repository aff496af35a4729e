"""Quality rules: plain counts of a text, and the perplexity of an n-gram model.

The model is interpolated modified Kneser-Ney over the bytes of the words
joined by single blanks, one per language, of order ORDER. Spark counts the
n-grams of every whole document that the base rules pass (what they reject is
no example of its language); each task leaves its counts folded. No text is
judged by a model that has seen it: texts are dealt to two folds by their
checksum, so copies stay together, and each fold is scored by the other's
model, or by its own where the other has none in that language. The lower
orders' continuation counts, the three discounts of each order and the
probabilities follow from these counts, and are stored as sorted arrays of
64-bit n-gram numbers (the bytes packed, so the hash is free of collisions)
searched by bisection.

The orders up to LOWER are broadcast: a language has at most 2^24 trigrams of
bytes, however large the corpus is. The two orders above grow with it and stay
a table. Documents are dealt to parts, and travel packed: a task compresses the
documents of a part together, as text is most of what moves. A part asks for
each of its n-grams once. An n-gram, its context, its suffix and the suffix's context all hold the
bytes in its middle, so counts and questions that share them meet in one task,
which has all it needs for both orders; the answers go back to their part.

Bands: the logarithm of the perplexity is gathered per language in bins of
BIN, again over the documents that the base rules pass; documents beyond SPREAD
times the distance from the median to the lower or upper quartile (MIN_DISTANCE
at least) are rejected. A perplexity on the edge of a band is kept.

Defined results: a null or blank text has no words, fails the base rules and
has no perplexity; a null language is the empty language, which has a model of
its own; a language of which no document passes the base rules has no model,
and its documents no perplexity; a very long text is a row like any other;
repeated rows count as rows; a null id is carried along; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import slices
from faultline.storage import materialize

LOWER = 3  # orders that every task holds
ORDER = LOWER + 2
PART_BYTES = 32_000_000  # text of a part of the documents; the larger, the fewer n-grams are asked for twice
MIN_PARTS, SMALL_PART = 24, 4_000_000  # fewer parts only where they would be smaller than that
ROWS = 500  # documents whose n-grams are folded at a time
PACK_BYTES = 32_000_000  # documents that a task holds before it packs them by part
BIN, SPREAD, MIN_DISTANCE = 0.001, 10.0, 0.02
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
_DOCUMENT = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    data = text.encode(errors="replace")
    words = data.split()
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def fold(text: str | None) -> int:
    """The fold (0 or 1) of a text."""
    return zlib.crc32((text or "").encode(errors="replace")) % 2


def fails(n_words, repeats):
    """The base rules' verdict, of numbers or of columns."""
    return (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = at[:-1] * len(ids) + at[1:]
    if len(ids) > 2_000_000:  # three ids no longer fit one number
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + at[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def ngrams(text: str | None, order: int) -> np.ndarray:
    """Per byte of the text's words (blank between): itself after the bytes before it, as one number."""
    data = b" ".join((text or "").encode(errors="replace").split())
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(bytes(order - 1) + data, np.uint8)
    keys = np.zeros(len(data), np.uint64)
    for k in range(order):
        keys = (keys << np.uint64(8)) | raw[k : len(data) + k]
    return keys


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, fold, gram, n over all rows of ``docs`` (lang, text) that the base rules pass."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        for part in slices(batches):
            by: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = (text or "").encode(errors="replace").split()
                if not fails(len(words), repeat_words(words)):
                    by.setdefault((lang, fold(text)), []).append(ngrams(text, order))
            for key, grams in by.items():
                held.setdefault(key, []).append(np.unique(np.concatenate(grams), return_counts=True))
                if len(held[key]) >= 32:
                    held[key] = [folded(held[key])]
        for (lang, half), parts in held.items():
            keys, n = folded(parts)
            for a in range(0, len(keys), 50_000):
                some = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([half] * len(some), pa.int32()),
                     pa.array(some.astype(np.int64)), pa.array(n[a : a + 50_000])], names=["lang", "fold", "gram", "n"])

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, fold int, gram long, n long")
    return counted.groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """One order: n-grams with log probability, contexts with log back-off weight; both sorted."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    logb: np.ndarray


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return (np.where(known, values[at], missing) if len(keys) else np.full(len(wanted), missing)), known


def discounts(kinds: np.ndarray) -> np.ndarray:
    """By count (0 to 3 and more), from how many n-grams have the counts 0 to 4."""
    kinds = np.asarray(kinds, float)
    y = kinds[1] / max(1.0, kinds[1] + 2 * kinds[2])
    cut = np.array([0.0, 0.5, 1.0, 1.5])
    for k in (1, 2, 3):
        if kinds[k] and kinds[k + 1] and (estimate := k - (k + 1) * y * kinds[k + 1] / kinds[k]) > 0:
            cut[k] = estimate
    return cut


class KneserNey:
    """Interpolated modified Kneser-Ney; natural logarithms.

    A discount that cannot be estimated, as no n-gram has one of the two counts
    it needs, is half its count. So none is zero, and an unseen byte costs what
    was discounted, not the smallest number there is.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int = LOWER,
                 below: KneserNey | None = None, cuts: list[np.ndarray] | None = None):
        """``below`` is the model of the lower orders, if some other has it; ``cuts`` the discounts of
        the orders above it, lowest first, if ``grams`` are not all there are."""
        self.order, self.below, self.base = order, below, below.order if below else 0
        self.levels: list[Level] = []
        tables = [(grams, counts)]
        for size in range(order - 1, self.base, -1):  # continuation counts: kinds of first byte
            mask = np.uint64((1 << 8 * size) - 1)
            tables.append(np.unique(tables[-1][0] & mask, return_counts=True))
        for at_level, (keys, n) in enumerate(reversed(tables)):
            size = self.base + at_level + 1
            cut = cuts[at_level] if cuts else discounts(np.bincount(np.minimum(n, 5), minlength=5))
            discount = cut[np.minimum(n, 3)]
            contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.bincount(at, n, len(contexts))
            back = np.bincount(at, discount, len(contexts)) / total
            lower = np.exp(self._log(keys & np.uint64((1 << 8 * (size - 1)) - 1), size - 1))
            p = (n - discount) / total[at] + back[at] * lower
            self.levels.append(Level(keys, np.log(p), contexts, np.log(back)))

    def _log(self, wanted: np.ndarray, size: int) -> np.ndarray:
        if size == self.base:
            return self.below._log(wanted, size) if self.below else np.full(len(wanted), -np.log(256.0))
        level = self.levels[size - 1 - self.base]
        logp, known = _find(level.grams, level.logp, wanted, 0.0)
        miss = np.flatnonzero(~known)
        if len(miss):
            back, _ = _find(level.contexts, level.logb, wanted[miss] >> np.uint64(8), 0.0)
            logp[miss] = back + self._log(wanted[miss] & np.uint64((1 << 8 * (size - 1)) - 1), size - 1)
        return logp

    def log_perplexity(self, grams: np.ndarray) -> float | None:
        if not len(grams):
            return None
        kinds, n = np.unique(grams, return_counts=True)
        return float(-(self._log(kinds, self.order) @ n) / len(grams))


@dataclass
class Model:
    """What every task holds of a language's fold: the lower orders, and the discounts of those above."""

    below: KneserNey
    cuts: list[np.ndarray]


def _shorter(counted: DataFrame, size: int) -> DataFrame:
    """Continuation counts of the next order."""
    return counted.groupBy("lang", "fold", F.col("gram").bitwiseAND((1 << 8 * size) - 1).alias("gram")).agg(
        F.count("*").alias("n"))


def train(counted: DataFrame) -> dict[tuple[str, int], Model]:
    """The lower orders of each language and fold, from the counts of order ORDER."""
    four = _shorter(counted, ORDER - 1)
    kinds = [F.count_if(F.col("n") == k).alias(f"k{k}") for k in range(1, 5)]
    known = {(r.lang, r.fold, size): [0, r.k1, r.k2, r.k3, r.k4]
             for size, table in ((ORDER - 1, four), (ORDER, counted))
             for r in table.groupBy("lang", "fold").agg(*kinds).collect()}
    three = _shorter(four, LOWER).toArrow()  # at most 2^24 rows a language and fold
    key = np.array([f"{half}{lang}" for lang, half in zip(three["lang"].to_pylist(), three["fold"].to_pylist(), strict=True)], object)
    gram, n = three["gram"].to_numpy().astype(np.uint64), three["n"].to_numpy()
    models = {}
    for name in sorted(set(key)):
        own = np.flatnonzero(key == name)
        own = own[np.argsort(gram[own])]
        lang, half = name[1:], int(name[0])
        models[lang, half] = Model(KneserNey(gram[own], n[own], LOWER),
                                   [discounts(known[lang, half, size]) for size in (ORDER - 1, ORDER)])
    return models


def _judge(models, lang: str, text: str | None) -> tuple[str, int] | None:
    half = fold(text)
    return next(((lang, h) for h in (1 - half, half) if (lang, h) in models), None)


def _middle(grams: np.ndarray, groups: int) -> np.ndarray:
    """The group of n-grams, by the bytes that their contexts and suffixes share."""
    return (grams >> np.uint64(8) & np.uint64((1 << 8 * (ORDER - 2)) - 1)) % np.uint64(groups)


def _packed(grams: np.ndarray) -> bytes:
    return np.diff(grams, prepend=np.uint64(0)).tobytes()  # differences of sorted numbers compress


def _unpacked(data: list[bytes]) -> list[np.ndarray]:
    return [np.cumsum(np.frombuffer(d, np.uint64)) for d in data]


def pack_documents(docs: DataFrame, parts: int) -> DataFrame:
    """part, docs: the rows of ``docs`` (doc_id, lang, text), dealt to parts; a row holds many, compressed together."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        rows = pa.Table.from_batches(held)
        rows = rows.take(np.argsort(rows["part"].to_numpy(), kind="stable"))
        numbers, starts = np.unique(rows["part"].to_numpy(), return_index=True)
        blobs = []
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, _DOCUMENT, options=options) as stream:
                stream.write_table(rows.slice(a, b - a).select(_DOCUMENT.names).cast(_DOCUMENT).combine_chunks())
            blobs.append(out.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "docs"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for some in slices(batches):
            held.append(some)
            size += some.nbytes
            if size >= PACK_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    part = F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(parts)).cast("int").alias("part")
    return docs.select(part, "doc_id", "lang", "text").mapInArrow(pack, "part int, docs binary")


def unpack_documents(packed: pa.Table) -> pa.Table:
    """doc_id, lang, text of rows that ``pack_documents`` made."""
    return pa.concat_tables([_DOCUMENT.empty_table(), *(pa.ipc.open_stream(b.as_buffer()).read_all() for b in packed["docs"])])


def _by_model(table: pa.Table) -> dict[tuple[str, int], list[int]]:
    """The rows of each (lang, fold) of ``table``."""
    places: dict[tuple[str, int], list[int]] = {}
    for i, name in enumerate(zip(table["lang"].to_pylist(), table["fold"].to_pylist(), strict=True)):
        places.setdefault(name, []).append(i)
    return places


def score(docs: DataFrame, counted: DataFrame, models: dict[tuple[str, int], Model]) -> DataFrame:
    """doc_id, lang, the base counts and log_perplexity of every row."""
    sc = docs.sparkSession.sparkContext
    sent, have = sc.broadcast(models), frozenset(models)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(size // PART_BYTES), min(MIN_PARTS, int(size // SMALL_PART))) + 1
    groups = max(parts, MIN_PARTS)
    dealt = pack_documents(docs, parts)
    asked_type = "part int, lang string, fold int, grp int, grams binary"
    asked_schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("fold", pa.int32()), ("grp", pa.int32()),
                              ("grams", pa.binary())])

    def ask(part: pa.Table) -> pa.Table:
        held: dict[tuple[str, int], np.ndarray] = {}
        own = unpack_documents(part)
        for a in range(0, own.num_rows, ROWS):
            some, by = own.slice(a, ROWS), {}
            for lang, text in zip(some["lang"].to_pylist(), some["text"].to_pylist(), strict=True):
                if name := _judge(have, lang, text):
                    by.setdefault(name, [held.get(name, np.zeros(0, np.uint64))]).append(ngrams(text, ORDER))
            held |= {name: np.unique(np.concatenate(grams)) for name, grams in by.items()}
        number, rows = part["part"][0].as_py(), []
        for (lang, half), grams in held.items():
            at = _middle(grams, groups)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order].astype(np.int64), prepend=-1))
            for some in np.split(order, starts[1:]) if len(order) else []:
                rows.append({"part": number, "lang": lang, "fold": half, "grp": int(at[some[0]]), "grams": _packed(grams[some])})
        return pa.Table.from_pylist(rows, asked_schema)

    def answer(counts: pa.Table, wanted: pa.Table) -> pa.Table:
        data, logs = wanted["grams"].to_pylist(), [b""] * wanted.num_rows
        keys, n = counts["gram"].to_numpy().astype(np.uint64), counts["n"].to_numpy()
        known = _by_model(counts) if len(data) else {}
        for name, rows in _by_model(wanted).items():
            own = np.array(known.get(name, []), np.int64)
            own = own[np.argsort(keys[own])]
            model, grams = sent.value[name], _unpacked([data[i] for i in rows])
            found = KneserNey(keys[own], n[own], ORDER, model.below, model.cuts)._log(np.concatenate(grams), ORDER)
            for i, some in zip(rows, np.split(found, np.cumsum([len(g) for g in grams])[:-1]), strict=True):
                logs[i] = some.tobytes()
        return wanted.select(asked_schema.names).append_column("logs", pa.array(logs, pa.binary()))

    asked = dealt.groupBy("part").applyInArrow(ask, asked_type)
    grp = F.shiftright("gram", 8).bitwiseAND((1 << 8 * (ORDER - 2)) - 1) % groups  # as in _middle
    answered = counted.withColumn("grp", grp.cast("int")).groupBy("grp").cogroup(asked.groupBy("grp")).applyInArrow(
        answer, asked_type + ", logs binary")

    def judge(part: pa.Table, answers: pa.Table) -> pa.Table:
        held, out, own = {}, [], unpack_documents(part)
        data, logp = answers["grams"].to_pylist(), answers["logs"].to_pylist()
        for name, rows in _by_model(answers).items():
            keys = np.concatenate(_unpacked([data[i] for i in rows]))
            order = np.argsort(keys)
            held[name] = keys[order], np.concatenate([np.frombuffer(logp[i]) for i in rows])[order]
        for a in range(0, own.num_rows, ROWS):
            some, counts, logs = own.slice(a, ROWS), [], []
            for lang, text in zip(some["lang"].to_pylist(), some["text"].to_pylist(), strict=True):
                counts.append(base_counts(text))
                grams, name = ngrams(text, ORDER), _judge(have, lang, text)
                if name and len(grams):
                    keys, values = held[name]
                    logs.append(float(-values[np.searchsorted(keys, grams)].sum() / len(grams)))
                else:
                    logs.append(None)
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            out.append(pa.Table.from_arrays(
                [some["doc_id"], some["lang"], *columns, pa.array(logs, pa.float64())], names=names))
        return pa.concat_tables(out) if out else pa.schema(
            [(c, pa.string() if c == "lang" else pa.float64() if c == names[-1] else pa.int64()) for c in names]).empty_table()

    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"]
    return dealt.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(
        judge, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
               "n_repeat_words long, log_perplexity double")


def bands(scored: DataFrame, spread: float = SPREAD, min_distance: float = MIN_DISTANCE) -> DataFrame:
    """lang, lower, upper: the log-perplexity band of each language, from exact counts by bin."""
    bins = (scored.filter(F.col("log_perplexity").isNotNull() & ~fails(F.col("n_words"), F.col("n_repeat_words")))
            .groupBy("lang", F.floor(F.col("log_perplexity") / BIN).alias("bin")).agg(F.count("*").alias("n")))
    # A language has a few thousand bins: a log perplexity lies below ln 256 plus the back-offs.
    up_to = F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    ranked = bins.select("lang", "bin", up_to.alias("up_to"), total.alias("total"))
    at = [F.min(F.when(F.col("up_to") >= q * F.col("total"), (F.col("bin") + 0.5) * BIN)).alias(name)
          for q, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    quarters = ranked.groupBy("lang").agg(*at)
    low, high = F.greatest(F.col("q2") - F.col("q1"), F.lit(min_distance)), F.greatest(F.col("q3") - F.col("q2"), F.lit(min_distance))
    return quarters.select("lang", (F.col("q2") - spread * low).alias("lower"), (F.col("q2") + spread * high).alias("upper"))


def judge_quality(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """doc_id, the base counts, base_failed, log_perplexity, lower, upper, kept of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                       F.col("text").cast("string"))
    counted = materialize(count_ngrams(rows), "ngrams")
    scored = materialize(score(rows, counted, train(counted)), "perplexity")
    failed = fails(F.col("n_words"), F.col("n_repeat_words"))
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return (scored.join(F.broadcast(bands(scored, spread)), "lang", "left")  # one row per language
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & F.coalesce(inside, F.lit(False)))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "kept", "lang", "log_perplexity", "lower", "upper"))
