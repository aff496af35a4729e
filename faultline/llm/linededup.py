"""Line dedup by a log-template tree.

A line's path in the tree is its token count and its first LEAD tokens; tokens
with a digit are variable from the start. The lines that reach one leaf are
folded into templates: a line joins the template with which it agrees on the
largest share of positions, SIMILARITY at least, and the positions where it
does not agree become variable. Lines are taken in a fixed order (by documents
they occur in, then by hash), so the outcome does not depend on the layout.

A template that occurs in MIN_TEXTS different texts or more is recurring: its
first line (smallest doc_id, then line number) stays, every other one goes.
Copies of one text count once, so a document and its exact copies are left to
document-level deduplication.

Only leaves in which different lines meet need the lines' tokens; they travel as
two bytes a token. Counting is by aggregates; a hot line or template
leaves each task as one row. Lines of fewer than MIN_TOKENS tokens are kept.

Defined results: a null text stays null and has no lines; an empty text has one
empty line; a null id counts as the largest; repeated rows are one text;
blank lines are kept; an empty table gives no rows; all columns of the input
are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import slices
from faultline.operators.skew import one_per_key
from faultline.storage import materialize

LEAD = 4
SIMILARITY = 0.6
MIN_TEXTS = 5
MIN_TOKENS = 3
KNOWN_TOKENS = 300_000
_DIGIT = re.compile("[0-9]")
VARIABLE = "<*>"


def masked(line: str) -> list[str]:
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
    return tokens


def parse_lines(docs: DataFrame, lead: int = LEAD, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc, text_hash, line_no, line (hash of the masked line), leaf, tokens; of ``docs`` (doc, text_hash, text)."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        h64 = xxhash.xxh3_64_intdigest

        def short(token: str) -> bytes:
            known[token] = got = (xxhash.xxh32_intdigest(token) & 0xFFFF).to_bytes(2, "little")
            return got

        for part in slices(batches):
            row, number, line, leaf, packed = [], [], [], [], []
            get = known.get
            if len(known) > KNOWN_TOKENS:
                known.clear()
            for i, text in enumerate(part.column(2).to_pylist()):
                for k, one in enumerate(text.split("\n")):
                    tokens = masked(one)
                    if len(tokens) < min_tokens:
                        continue
                    row.append(i)
                    number.append(k)
                    line.append(h64(" ".join(tokens)))
                    leaf.append(h64(f"{len(tokens)} " + " ".join(tokens[:lead])))
                    packed.append(b"".join([get(t) or short(t) for t in tokens]))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), pa.array(number, pa.int32()),
                 pa.array(np.array(line, np.uint64).view(np.int64)), pa.array(np.array(leaf, np.uint64).view(np.int64)),
                 pa.array(packed, pa.binary())],
                names=["doc", "text_hash", "line_no", "line", "leaf", "tokens"])

    return docs.select("doc", "text_hash", "text").mapInArrow(
        parse, "doc long, text_hash long, line_no int, line long, leaf long, tokens binary")


def fold_leaf(lines: np.ndarray, tokens: list[bytes], similarity: float) -> np.ndarray:
    """For each line of one leaf, the first line of its template."""
    matrix = np.stack([np.frombuffer(t, "<u2") for t in tokens])
    shape = np.empty_like(matrix)
    fixed = np.ones(matrix.shape, bool)
    first, found = np.empty(len(lines), np.int64), 0
    head = np.empty(len(lines), lines.dtype)
    for i, row in enumerate(matrix):
        if found:
            same = (shape[:found] == row) & fixed[:found]
            share = same.mean(1)
            best = int(share.argmax())
            if share[best] >= similarity:
                fixed[best] &= shape[best] == row
                first[i] = best
                continue
        shape[found], head[found], first[i] = row, lines[i], found
        found += 1
    return head[first]


def generalise(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(line, template) for the lines that share a template with another line.

    ``lines``: line, leaf, tokens, texts; one row per distinct line. Leaves are
    streamed in order; a task holds the different lines of one leaf at a time.
    """

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(group: list) -> pa.RecordBatch:
            own = np.array([g[0] for g in group], np.int64)
            head = fold_leaf(own, [g[1] for g in group], similarity)
            moved = head != own
            return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(head[moved])], names=["line", "template"])

        leaf, group = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1 if len(keys) else np.zeros(0, np.int64)
            for a, b in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]]), strict=True):
                a, b = int(a), int(b)
                if a == b:
                    continue
                if keys[a] != leaf:
                    if len(group) > 1:
                        yield result(group)
                    leaf, group = keys[a], []
                part = batch.slice(a, b - a)
                group += zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
        if len(group) > 1:
            yield result(group)

    ordered = lines.repartition("leaf").sortWithinPartitions("leaf", F.desc("texts"), "line")
    return ordered.select("leaf", "line", "tokens").mapInArrow(fold, "line long, template long")


def drop_recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, similarity: float = SIMILARITY,
                         lead: int = LEAD, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """row (struct of the input's columns), text (without recurring lines), n_lines, n_dropped."""
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"),
                       F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = materialize(parse_lines(rows.filter("text is not null"), lead, min_tokens), "lines")
    # A leaf with one line needs no tokens: they travel for the others alone.
    leaves = found.groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a <> b").select("leaf")
    per_text = found.groupBy("line", "leaf", "text_hash").agg(F.lit(1).alias("one"))
    texts = per_text.groupBy("line", "leaf").agg(F.count("*").alias("texts"))
    several = texts.join(leaves, "leaf")
    tokens = found.join(leaves, "leaf", "left_semi").select("line", "tokens").dropDuplicates(["line"])
    moved = materialize(generalise(several.join(tokens, "line"), similarity), "templates")

    seen = found.select("doc", "text_hash", "line_no", "line").join(moved, "line", "left")
    seen = seen.withColumn("template", F.coalesce("template", "line")).drop("line")
    by_text = seen.groupBy("template", "text_hash").agg(F.min("doc").alias("doc"), F.min("line_no").alias("line_no"))
    recurring = (by_text.groupBy("template")
                 .agg(F.count("*").alias("texts"), F.min("doc").alias("first_doc"),
                      F.min_by("line_no", F.struct("doc", "line_no")).alias("first_line"))
                 .filter(F.col("texts") >= min_texts))
    gone = (seen.join(one_per_key(recurring, "template"), "template")
            .filter("not (doc = first_doc and line_no = first_line)"))
    gone = gone.groupBy("doc", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    # The drops are the small side: hashed, so that the texts are not sorted.
    joined = rows.join(gone.hint("shuffle_hash"), ["doc", "text_hash"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return joined.select(
        "row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
