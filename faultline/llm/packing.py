"""Best-fit packing of tokenised documents under several capacities.

Vector best-fit: an item has three sizes (tokens, documents, attention cost =
tokens squared) and so has every sequence's room. Items come in decreasing
length; each goes to the open sequence in which it fits under *every* capacity
and whose weighted residual norm after placing is smallest (``rule="norm"``),
or whose room has the largest weighted dot product with the item
(``rule="dot"``); where it fits nowhere, a sequence is opened.

Items are dealt at random to groups of a fixed mean size, and the groups are
packed side by side: at most a few sequences per group stay partly filled.

Defined results: a null text is an empty document (the end id alone); a
repeated row is packed again; a null id is carried along; an empty table gives
no rows; other columns are ignored. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import slices
from faultline.storage import materialize

#: Mean items of a group that one task packs.
GROUP_ITEMS = 16_384
#: Entries after which a worker forgets its known words (bounded memory).
KNOWN_WORDS = 500_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Below U+0250 the letters and numbers are listed, so that the standard regex
# engine splits such texts as the tokenizer's own pattern does.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\\t-\\r \\x85\\xa0"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}{_SPACE}]+")
#: Characters for which lower-casing and splitting need no neighbour and no table.
_PLAIN = re.compile("[\\t\\n\\r -~\xa0-įı-ɏ]*")


class CachedTokenizer:
    """Ids of whole texts, equal to the tokenizer's, with each distinct word encoded once.

    The tokenizer splits a text into words before merging, and merges within a
    word only; so a text's ids are its words' ids in order. A text with
    characters outside ``_PLAIN`` or a special token goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.letters = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x250)}
        self.composed = __import__("unicodedata").is_normalized

    def _word(self, word: str) -> bytes:
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(word.translate(self.letters)))
        self.known[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        get, word = self.known.get, self._word
        return b"".join([get(w) or word(w) for w in _SPLIT.findall(text.lower())])


_WORKER: dict[str, CachedTokenizer] = {}


def _tokenizer(path: str) -> CachedTokenizer:
    if path not in _WORKER:
        _WORKER[path] = CachedTokenizer(path)
    return _WORKER[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Whole documents as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.freeze()
        tok, end, width = _tokenizer(path), int(end_id).to_bytes(4, "little"), 4 * capacity
        for part in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = tok.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    piece = ids[at : at + width]
                    out.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float],
             weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item; ``lengths`` in decreasing order."""
    cap, w = np.asarray(capacity, float), np.asarray(weights, float)
    size = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / cap
    tokens = np.rint(lengths).astype(np.int64)
    room = np.ones((1024, 3))
    name = np.zeros(1024, np.int64)
    used = np.zeros(len(lengths) + 1, np.int64)
    opened, count = 0, 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    slack = 1e-12
    for i, item in enumerate(size):
        if i % 512 == 0 and opened:  # full sequences leave the list
            open_ = np.flatnonzero((room[:opened] > slack).all(1))
            room[: len(open_)], name[: len(open_)] = room[open_], name[open_]
            opened = len(open_)
        left = room[:opened] - item
        fits = (left >= -slack).all(1)
        if fits.any():
            score = (w * left**2).sum(1) if rule == "norm" else -(room[:opened] * (w * item)).sum(1)
            at = int(np.where(fits, score, np.inf).argmin())
        else:
            if opened == len(room):
                room, name = np.concatenate([room, room]), np.concatenate([name, name])
            at, room[opened], name[opened] = opened, 1.0, count
            opened, count = opened + 1, count + 1
        room[at] -= item
        where[i], offset[i] = name[at], used[name[at]]
        used[name[at]] += tokens[i]
    return where, offset


def pack(items: DataFrame, capacity: int = 2048, max_documents: int | None = None,
         max_attention: float | None = None, rule: str = "norm",
         weights: tuple[float, float, float] = (1.0, 0.01, 0.01), group_items: int = GROUP_ITEMS) -> DataFrame:
    """``items`` (PIECE_SCHEMA) with sequence_id and offset.

    ``max_documents`` and ``max_attention`` left out never bind: a sequence of
    ``capacity`` tokens has at most that many items and that number squared as cost.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    caps = (float(capacity), float(max_documents or capacity), float(max_attention or capacity * capacity))
    staged = materialize(items.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-staged.count() // group_items))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_item"], ascending=[False, True], kind="stable")
        where, offset = best_fit(rows["length"].to_numpy(), caps, weights, rule)
        rows["sequence_id"] = rows["_group"].to_numpy() * (1 << 32) + where
        rows["offset"] = offset
        return rows.drop(columns=["_item", "_group"])

    dealt = staged.withColumn("_group", F.pmod(F.xxhash64("_item"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(fill, PIECE_SCHEMA + ", sequence_id long, offset long")
