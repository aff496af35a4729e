"""Prefix trie of conversations by whole-sequence collapse.

Conversations that are equal turn by turn become one weighted sequence, which
stands for all of them and keeps the list of its ends. Everything else works on
distinct sequences: a sequence that is a proper prefix of another is dropped by
an anti-join, what remains are the leaves; and every prefix (node) gets
its sums from the weighted sequences that run through it, in two aggregates. No
step goes level by level, so the depth of the trie costs no rounds.

A turn travels as a 128-bit digest and its length, never as text. A prefix is named by
a chained digest, computed in one pass over a conversation's turns in order: such a pass
streams, so a conversation of any length needs no memory of its own. Sums over a subtree
are sums along sequences: a sequence adds, at a node, what its own turns from that
node on hold; the part that distinct nodes count once is added by the sequence
that owns them, the one with a node's smallest conversation. The owned nodes of a sequence
are its last ones, so one number says where they begin.

Aggregates by node have a map-side half, so the root and a very common first
turn, through which most sequences run, leave each task as one row.

Defined results: turns stand by turn number, null first, equal numbers by the
digest of role and text; a null role or text is empty; rows without a
conversation id belong to none and are left out; a repeated row is a turn of its
own; an empty table has no conversations and no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import list_digests
from faultline.operators.skew import one_per_key
from faultline.storage import materialize

ROOT = bytes(16)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_PREFIXES = "conv_id long, depth long, node binary, parent binary, chars long, before long, last boolean"


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), digest, chars of every turn of ``conversations`` (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The role's length in front keeps (role, text) pairs apart.
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")) - 1
    return rows.select("conv_id", place.cast("long").alias("at"), "digest", "chars")


def graft(turns: DataFrame, donor: Column, keep: Column, most: int) -> DataFrame:
    """Rows like ``turns``, every conversation rebuilt, and one row per conversation with ``at`` -1.

    A conversation becomes the first ``keep`` (``most`` at most) turns of
    conversation ``donor`` (all, if it has fewer) and its own turns after its first ``keep``.
    """
    ids = turns.select("conv_id").distinct().select("conv_id", donor.alias("donor"), keep.cast("long").alias("keep"))
    heads = turns.filter(F.col("at") < most).withColumnRenamed("conv_id", "donor")
    given = ids.join(heads, "donor").filter("at < keep").select("conv_id", "at", "digest", "chars")
    own = turns.withColumn("keep", keep).filter("at >= keep").drop("keep")
    return given.union(own).union(_starts(ids))


def _starts(ids: DataFrame) -> DataFrame:
    return ids.select("conv_id", F.lit(-1).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long"))


def whole(turns: DataFrame) -> DataFrame:
    """Rows like ``turns``, as they are, and one row per conversation with ``at`` -1."""
    return turns.union(_starts(turns.select("conv_id").distinct()))


@dataclass
class Collapsed:
    """``prefixes``: a row per conversation and prefix; ``sequences``: one per distinct sequence, with weight and leaf."""

    prefixes: DataFrame
    sequences: DataFrame


def _chain(turns: DataFrame) -> DataFrame:
    """The prefixes of every conversation, the empty one included, with the digest that names each."""

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the row before: it is its conversation's last if the next one is another's
        for batch in batches:
            out: list[list] = []
            for conv, at, digest, chars in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None:
                    held[6] = held[0] != conv
                    out.append(held)
                if at < 0:
                    held = [conv, 0, ROOT, None, 0, 0, True]
                else:
                    node = hashlib.blake2b(held[2] + digest, digest_size=16).digest()
                    held = [conv, held[1] + 1, node, held[2], chars, held[5] + held[4], True]
            yield _batch(out)
        if held is not None:
            yield _batch([held])

    def _batch(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                          names=["conv_id", "depth", "node", "parent", "chars", "before", "last"])

    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "at")
            .mapInArrow(chain, _PREFIXES))


def collapse(turns: DataFrame) -> Collapsed:
    """The distinct sequences of ``turns`` (from ``whole`` or ``graft``), weighted; leaves are those no other one begins with."""
    prefixes = materialize(_chain(turns), "prefixes")
    sequences = prefixes.filter("last").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("depth").alias("depth"),
        F.first(F.col("before") + F.col("chars")).alias("total"))
    sequences = materialize(sequences, "sequences")
    # Proper prefixes are the parents of nodes; every node lies on a sequence.
    inner = prefixes.filter("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaves = sequences.join(inner, "node", "left_anti").select("node", F.lit(True).alias("leaf"))
    flagged = sequences.join(leaves, "node", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    return Collapsed(prefixes, materialize(flagged, "sequences"))


def ends(collapsed: Collapsed) -> DataFrame:
    """node, n, sha256 of the comma-joined conversation ids of every distinct sequence, ascending."""
    return list_digests(collapsed.prefixes.filter("last"), "node", "conv_id")


def leaf_turns(conversations: DataFrame, collapsed: Collapsed) -> DataFrame:
    """The turns of one conversation of each leaf (the smallest), with its weight: the corpus without covered sequences.

    For ``conversations`` collapsed as they are (``whole``).
    """
    leaves = collapsed.sequences.filter("leaf").select("conv_id", "weight")
    return conversations.withColumn("conv_id", F.col("conv_id").cast("long")).join(one_per_key(leaves, "conv_id"), "conv_id")


def nodes(collapsed: Collapsed) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    sequences = collapsed.sequences
    weights = one_per_key(sequences.select("conv_id", "weight"), "conv_id")
    steps = collapsed.prefixes.select("conv_id", "depth", "node", "parent", "before")
    node = steps.join(weights, "conv_id").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        F.first("before").alias("before"), F.sum("weight").alias("n_convs"))
    node = materialize(node, "nodes")
    # The nodes a sequence owns are its last ones: from ``owned`` characters on.
    owned = node.groupBy("conv_id").agg(F.min("before").alias("owned"))
    runs = sequences.select("conv_id", "weight", "total", "leaf").join(owned, "conv_id", "left")
    saved = (F.col("weight") * (F.col("total") - F.col("before"))
             - F.when(F.col("owned").isNull(), 0).otherwise(F.col("total") - F.greatest("before", "owned")))
    along = steps.join(one_per_key(runs, "conv_id"), "conv_id").select(
        "node", saved.alias("saved"), F.col("leaf").cast("long").alias("leaves"), F.lit(0).cast("long").alias("children"))
    below = node.filter("parent is not null").select(F.col("parent").alias("node"), F.lit(0).cast("long"), F.lit(0).cast("long"),
                                                     F.lit(1).cast("long"))
    sums = along.union(below).groupBy("node").agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.sum("children").alias("n_children"))
    lists = ends(collapsed).select("node", "sha256")
    above = one_per_key(node.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    out = node.join(sums, "node").join(lists, "node", "left").join(above, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
