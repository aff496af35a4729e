"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Every permutation gives two signature values, the smallest and the largest
hash of the set, so a signature of 2 x PERMUTATIONS values costs half the hash
evaluations. A band is BAND_ROWS values of different permutations; documents
that agree on a band are candidates. At a similarity of 0.8 a pair shares none
of the 32 bands with a probability of 3 in a million.

Documents with equal sets are one class from the start. Within a bucket, the
classes are compared with a few pivots first, not with each other: after each
round, what the confirmed links connect needs no further comparison. After the
first round, pairs are left out that cannot link, by an exact bound on the
shingles they can share; the last round takes all pairs of a bucket that are still in
two components and pass that bound. So no candidate that could change a component
is skipped, and a group of thousands of copies costs about one comparison a copy.

Defined results: a text without words (null, empty, blank) has an empty set and
links with nothing; a text with fewer words than a shingle is one shingle; a
repeated row is a document of its own with the same set; a null id is never the
smallest of a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import release, slices
from faultline.llm.components import components
from faultline.storage import materialize

PERMUTATIONS = 80
BAND_ROWS = 5
SEED = 20_240_607
#: Cells of the hash range in which sets are counted to bound what two of them share.
CELLS = 128
#: Pivots of the round before the blocks, and members of a block.
PIVOTS, BLOCK = 8, 64
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Per text its distinct shingles of lower-cased (A-Z) words, as sorted 64-bit hashes."""
    split = [(t or "").encode(errors="replace").lower().split() for t in texts]
    size = np.array([len(s) for s in split], np.int64)
    hashed = np.fromiter((h for s in split for h in map(xxhash.xxh3_64_intdigest, s)), np.uint64, int(size.sum()))
    rolled = hashed.copy()
    for k in range(1, words):
        rolled[: len(rolled) - k] = rolled[: len(rolled) - k] * _M + hashed[k:]
    rolled = _mix(rolled)
    out, at = [], 0
    for n in size.tolist():
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            short = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in hashed[at : at + n]:
                    short = short * _M + h
            out.append(_mix(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _band_values(sets: list[np.ndarray]) -> np.ndarray:
    """One row per (non-empty) set: a 64-bit value for each band."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
    every = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    signature = np.empty((2 * PERMUTATIONS, len(sets)), np.uint64)
    for k in range(PERMUTATIONS):
        permuted = (every ^ b[k]) * a[k]
        signature[k] = np.minimum.reduceat(permuted, starts)
        signature[PERMUTATIONS + k] = np.maximum.reduceat(permuted, starts)
    bands = 2 * PERMUTATIONS // BAND_ROWS
    value = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(sets), 1)
    for r in range(BAND_ROWS):
        value = _mix(value * _M + signature[r::BAND_ROWS][:bands])
    return value.T


def _key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (of the set; null if empty), bands."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column(2).to_pylist(), words)
            some = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if some:
                for i, row in zip(some, _band_values([sets[i] for i in some]).view(np.int64), strict=True):
                    bands[i] = row
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "key", "bands"])

    return _rows(docs).mapInArrow(
        sign, "doc_id long, text_hash long, n_shingles long, key binary, bands array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
                       F.col("text").cast("string"))


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    one = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(one, "b").join(two, "a").select("a", "b", "text_a", "text_b")

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)
        for part in slices(batches):
            left, right = part.column(0).to_pylist(), part.column(1).to_pylist()
            sets, keep = shingle_sets(part.column(3).to_pylist(), words), []
            for i, a in enumerate(left):
                if a != last:
                    last, mine = a, shingle_sets([part.column(2)[i].as_py()], words)[0]
                both = len(np.intersect1d(mine, sets[i], assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(sets[i]) - both))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, k in zip(left, keep, strict=True) if k], pa.int64()),
                 pa.array([b for b, k in zip(right, keep, strict=True) if k], pa.int64())], names=["a", "b"])

    return joined.mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of ``docs``: doc_id, text_hash, n_shingles, component_id (smallest doc_id of the group), kept, stays.

    ``kept``: the id is its component's. ``stays``: true for one row of each group, also where ids repeat.
    """
    signed = materialize(signatures(docs, words).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    # One class per distinct set; its first row stands for it.
    classes = signed.filter("key is not null").groupBy("key").agg(F.min("uid").alias("uid"))
    reps = signed.join(classes, ["key", "uid"])
    members = reps.select(F.explode("bands").alias("bucket"), "uid", F.col("n_shingles").alias("n"))
    shared = members.groupBy("bucket").agg(F.min("uid").alias("hub"), F.max("uid").alias("last")).filter("hub < last")
    members = materialize(members.join(shared.select("bucket", "hub"), "bucket"), "buckets", narrow=True)
    wanted = members.select("uid").distinct().join(signed.select("uid", "doc_id", "text_hash", "key"), "uid")
    texts = materialize(_texts(docs, wanted, words), "texts")

    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    sizes = members.select(F.col("uid").alias("hub"), F.col("n").alias("m")).distinct()
    pairs = (members.filter("uid > hub").select("hub", "uid", "n").distinct().join(sizes, "hub").filter(fits)
             .select(F.col("hub").alias("a"), F.col("uid").alias("b")))
    first = materialize(pairs, "pairs", narrow=True)
    tested = first.union(first.select("b", "a"))
    release(docs.sparkSession)
    labels = components(_linked(first, texts, words, percent))
    # Buckets that are not one component yet: the members that can still link, those with the fewest shingles of their own first.
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("n") - F.col("most"), "uid"))
    mixed = materialize(_open(members.select("bucket", "uid", "n"), labels).drop("label"), "open", narrow=True)
    if mixed.isEmpty():
        return _result(signed, classes, labels)
    release(docs.sparkSession)
    still = _viable(mixed, texts, words, percent)
    ranked = materialize(_open(still, labels).withColumn("rank", rank), "ranked")
    rough = f"100 * least(most, most_a) >= {percent} * (n + n_a - least(most, most_a))"
    for whole in (False, True):
        release(docs.sparkSession)
        if whole:
            pairs = _block_pairs(ranked, percent)
        else:
            pivots = ranked.filter(F.col("rank") <= PIVOTS).select(
                "bucket", *[F.col(c).alias(f"{c}_a") for c in ("uid", "n", "most", "shared", "label", "rank")])
            pairs = ranked.join(pivots, "bucket").filter(f"label <> label_a and rank > rank_a and {rough}")
            pairs = pairs.select("uid_a", "uid", "n_a", "n", "shared_a", "shared").mapInArrow(_close(percent), "a long, b long")
        pairs = materialize(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs", narrow=True)
        if pairs.isEmpty():
            continue
        tested = tested.union(pairs.union(pairs.select("b", "a")))
        labels = components(_linked(pairs, texts, words, percent), labels)
        if not whole:
            ranked = materialize(_open(ranked.drop("label"), labels), "ranked")
            if ranked.isEmpty():
                break
    return _result(signed, classes, labels)


def _texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """uid and text of the wanted classes; of several rows with one id, the one with the class's set.

    Joined by id and text, so that rows with one id (or none) meet only those of their own text.
    """
    rows = _rows(docs).toDF("_id", "_hash", "text")
    same_row = rows["_id"].eqNullSafe(wanted["doc_id"]) & rows["_hash"].eqNullSafe(wanted["text_hash"])
    # The ids are the small side: hashed, so that the texts are not sorted.
    joined = rows.join(wanted.hint("shuffle_hash"), same_row).select("uid", "key", "text")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column(2).to_pylist(), words)
            same = pa.array([len(s) > 0 and _key(s) == k for s, k in zip(sets, part.column(1).to_pylist(), strict=True)])
            yield part.filter(same).select(["uid", "text"])

    return joined.mapInArrow(check, "uid long, text string").dropDuplicates(["uid"])


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets with more than one component, with their label."""
    labelled = (members.join(labels.withColumnRenamed("id", "uid"), "uid", "left")
                .withColumn("label", F.coalesce("root", "uid")).drop("root"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    return labelled.join(mixed.select("bucket"), "bucket")


def _cells(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), CELLS)


def _close(percent: int):
    """Of the pairs (a, b, sizes, shared cells), those whose bound reaches the similarity."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                part = whole.slice(at, 2_000)
                common = np.minimum(_cells(part.column(4)), _cells(part.column(5))).sum(1).astype(np.int64)
                size = part.column(2).to_numpy() + part.column(3).to_numpy()
                ok = pa.array(100 * common >= percent * (size - common))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    return keep


def _block_pairs(ranked: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of one bucket and two components whose bound reaches the similarity.

    Members stand in blocks of BLOCK, those of one component side by side. Blocks
    meet as rows, unless all of both is one component; a task compares two
    blocks at a time and emits only pairs that pass.
    """
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("label", "uid")) - 1
    member = F.struct("uid", "n", "label", "shared")
    blocks = ranked.withColumn("block", F.floor(place / BLOCK)).groupBy("bucket", "block").agg(
        F.collect_list(member).alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    blocks = materialize(blocks, "blocks")
    other = blocks.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("block", "rows", "lo", "hi")])
    met = blocks.join(other, "bucket").filter("block <= block_b and not (lo = hi and lo_b = hi_b and lo = lo_b)")

    def columns(rows: pa.Array) -> tuple[np.ndarray, ...]:
        flat = rows.flatten()
        return (*(flat.field(k).to_numpy() for k in ("uid", "n", "label")), _cells(flat.field("shared")).astype(np.int32))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (u, n, label, cells), (v, m, other, theirs) = (columns(batch.column(k).slice(at, 1)) for k in (0, 1))
                a, b = [], []
                for i in range(len(u)):
                    common = np.minimum(cells[i], theirs).sum(1)
                    ok = (other != label[i]) & (100 * common >= percent * (n[i] + m - common))
                    b.append(v[ok])
                    a.append(np.full(len(b[-1]), u[i]))
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return met.select("rows", "rows_b").mapInArrow(meet, "a long, b long")


def _viable(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The members that can still reach the similarity with a member of their bucket, with ``shared``.

    ``shared`` counts, in each of CELLS cells of the hash range, a set's shingles that
    another of these documents has too. Two sets have at most the sum of the
    cells' minima in common, which bounds their similarity exactly: what the
    bound leaves out cannot link.
    """
    wanted = members.select("uid").distinct()

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(part.column(1).to_pylist(), words)
            size = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(size), pa.array(np.concatenate(sets).view(np.int64))],
                                             names=["uid", "shingle"])

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for s, own in zip(shingle_sets(part.column(1).to_pylist(), words), part.column(2).to_pylist(), strict=True):
                count = np.bincount((s % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
                for cell in own or ():
                    count[cell["cell"]] -= cell["k"]
                rows.append(count)
            shared, most = [c.astype("<u4").tobytes() for c in rows], [int(c.sum()) for c in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared, pa.binary()), pa.array(most, pa.int64())],
                                             names=["uid", "shared", "most"])

    held = texts.join(wanted, "uid").select("uid", "text")
    alone = (held.mapInArrow(shingles, "uid long, shingle long").groupBy("shingle")
             .agg(F.min("uid").alias("uid"), F.count("*").alias("k")).filter("k = 1"))
    # CELLS is a power of two: the low bits of the signed number are those of the unsigned one.
    own = alone.groupBy("uid", F.col("shingle").bitwiseAND(CELLS - 1).cast("int").alias("cell")).agg(F.count("*").alias("k"))
    own = own.groupBy("uid").agg(F.collect_list(F.struct("cell", "k")).alias("own"))
    counted = held.join(own, "uid", "left").mapInArrow(cells, "uid long, shared binary, most long")
    counted = materialize(members.join(counted, "uid"), "shared")
    least = counted.groupBy("bucket").agg(F.min("n").alias("least"))
    best = f"100 * most >= {percent} * (greatest(least, most) + n - most)"
    return counted.join(least, "bucket").filter(best).select("bucket", "uid", "n", "most", "shared")


def _result(signed: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    groups = (classes.join(labels.withColumnRenamed("id", "uid"), "uid", "left")
              .select("key", F.coalesce("root", "uid").alias("root")))
    rows = signed.select("doc_id", "text_hash", "n_shingles", "key", "uid").join(groups, "key", "left")
    rows = rows.withColumn("root", F.coalesce("root", "uid"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    least = rows.groupBy("root").agg(F.min(order).alias("first")).select("root", "first.doc_id", "first.uid")
    least = least.toDF("root", "component_id", "first_uid")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return rows.join(least, "root").select(
        "doc_id", "text_hash", "n_shingles", "component_id", kept.alias("kept"),
        (F.col("uid") == F.col("first_uid")).alias("stays"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group."""
    # A null id is no number: a flag keeps it apart from every id there is.
    none, number = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    key = ["_none", "_doc", "text_hash"]
    groups = near_duplicates(docs, words, percent).withColumn("_none", none).withColumn("_doc", number)
    stay = (groups.groupBy(*key).agg(F.max("stays").alias("stays"), F.count("*").alias("rows"))
            .filter("stays").select(*key, "rows"))
    stay = materialize(stay, "stay")
    release(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), none.alias("_none"), number.alias("_doc"),
                       F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    # The decisions are the small side: hashed, so that the texts are not sorted.
    kept = rows.join(stay.hint("shuffle_hash"), key)
    out = kept
    if not stay.filter("rows > 1").isEmpty():  # repeated rows: one of each
        out = kept.filter("rows = 1").unionByName(kept.filter("rows > 1").dropDuplicates(key))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
