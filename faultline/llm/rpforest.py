"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

TREES trees are grown on a sample of SAMPLE vectors (the sample only places the
splits): a node splits at a gap near the median of a random projection, and
vectors within a band around the split go both ways. A node ends as a leaf at
about LEAF vectors, or where its vectors are so close together that a split
would only part links, or, open, where its sample is used up. Spark counts the
vectors that reach an open leaf; where they are too many, a task grows a
subtree from a fresh sample of that leaf's own vectors, which are routed on,
and so forth until no open leaf is too large. So the depth follows the table and not the
sample, and the subtrees stay a table and are never gathered on the driver.
*Every* vector is routed down every tree and compared, in double precision,
with the vectors of its leaves; a leaf of more than BLOCK vectors is compared
block by block in separate tasks. So there is no cap on a leaf.

A pair that meets in several leaves is counted in the first of them only:
each vector carries the numbers of all its leaves. Links are not written as
pairs: a task returns, per vector, the links it counted and the smallest id
its links connect it with, which are then united.

Equal vectors are one class with a weight from the start.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components links with nothing; vectors of different lengths are compared as if
the shorter were padded with zeros; a repeated row is a vector of its own; a null id is
never the smallest of a component; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.components import components
from faultline.operators.skew import one_per_key
from faultline.storage import materialize

TREES, LEAF, BLOCK = 8, 800, 2_048
SAMPLE, SEED = 50_000, 20_240_607
#: Share of a node's sample on each side of the split that goes both ways.
OVERLAP = 0.08
#: Least half-width of that band, in standard deviations of the projected difference of a pair at the threshold.
BAND = 0.6
#: Length of a node's mean vector from which it is not split.
TIGHT = 0.93
#: Sampled vectors that a node needs to be split.
LEAST = 16
#: Vectors of an open leaf that place the splits of its subtree, about; and those that one task routes.
SUBSAMPLE, ROUTED = 4_000, 200_000


def unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide = wide / np.abs(wide).max(1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(1, keepdims=True))


class Forest:
    """Split directions and bands of all trees, in one list of nodes; leaves are numbered throughout."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.nodes: list[tuple[np.ndarray, float, float, int, int]] = []  # direction, low, high, left, right
        self.roots: list[int] = []  # a node's number, or -1 - the leaf's
        self.leaves = 0
        self.open: set[int] = set()  # leaves that ended for want of sampled vectors
        scale = rows / max(1, len(sample))
        least = BAND * np.sqrt(2 - 2 * cosine) / np.sqrt(dim)

        def grow(at: np.ndarray) -> int:
            held = sample[at]
            done = len(at) * scale <= leaf or np.linalg.norm(held.mean(0)) >= TIGHT
            if done or len(at) < LEAST:
                if not done:
                    self.open.add(self.leaves)
                self.leaves += 1
                return -self.leaves
            for _ in range(8):
                direction = rng.standard_normal(dim)
                direction /= np.linalg.norm(direction)
                x = held @ direction
                s = np.sort(x)
                n = len(s)
                # The widest gap between the 40 % and 60 % quantiles, measured over a twentieth of the sample.
                step, lo, hi = max(1, n // 20), int(0.4 * n), max(int(0.4 * n) + 1, int(0.6 * n))
                mids = np.arange(lo, hi)
                a, b = np.maximum(mids - step, 0), np.minimum(mids + step, n - 1)
                cut = s[mids[int((s[b] - s[a]).argmax())]]
                rank = np.searchsorted(s, cut)
                low = min(s[max(0, rank - int(OVERLAP * n))], cut - least)
                high = max(s[min(n - 1, rank + int(OVERLAP * n))], cut + least)
                left, right = at[x <= high], at[x >= low]
                if max(len(left), len(right)) < 0.9 * n:
                    number = len(self.nodes)
                    self.nodes.append((direction, low, high, 0, 0))
                    one, two = grow(left), grow(right)
                    self.nodes[number] = (direction, low, high, one, two)
                    return number
            self.leaves += 1  # the vectors lie too close together
            return -self.leaves

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample))))
            if rows <= leaf:  # one leaf holds all: further trees would repeat it
                break

    def route(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The (sorted) leaves of each vector."""
        row, leaf = [], []
        todo = [(root, np.arange(len(vectors))) for root in self.roots]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                row.append(at)
                leaf.append(np.full(len(at), -node - 1))
                continue
            direction, low, high, left, right = self.nodes[node]
            x = vectors[at] @ direction
            todo += [(left, at[x <= high]), (right, at[x >= low])]
        rows, leaves = np.concatenate(row), np.concatenate(leaf)
        order = np.lexsort((leaves, rows))
        return np.split(leaves[order], np.cumsum(np.bincount(rows, minlength=len(vectors)))[:-1])


def _valid(v):
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0)


def _prepared(vectors: DataFrame) -> tuple[DataFrame, str, int]:
    """uid, vec_id, key and vec (raw bytes; both null where it links with nothing); the number type; the length."""
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind, cast = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(cast).alias("v"))
    rows = rows.withColumn("v", F.when(_valid(F.col("v")), F.col("v")))
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    dim = max(1, dim or 0)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                part = whole.slice(at, 2_000)
                packed = []
                for v in part.column(1):
                    if not v.is_valid:
                        packed.append(None)
                        continue
                    own = np.zeros(dim, kind)
                    values = v.values.to_numpy()
                    own[: len(values)] = values
                    packed.append((own + 0.0).astype(kind).tobytes())  # -0.0 is 0.0
                keys = [xxhash.xxh3_128_digest(p) if p is not None else None for p in packed]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
                                                 names=["vec_id", "key", "vec"])

    packed = rows.mapInArrow(pack, "vec_id long, key binary, vec binary")
    return materialize(packed.withColumn("uid", F.monotonically_increasing_id()), "vectors"), kind, dim


def _compare(cosine: float, kind: str, dim: int):
    """For the vectors of one leaf, or of two of its blocks: links counted here, and the smallest id reached."""

    def compare(group: pa.Table) -> pa.Table:
        uid, weight = group["uid"].to_numpy(), group["weight"].to_numpy()
        v = unit(np.frombuffer(b"".join(group["vec"].to_pylist()), kind).reshape(len(uid), dim))
        block, leaf = group["block"].to_numpy(), group["leaf"][0].as_py()
        left, right = np.flatnonzero(block == group["i"][0].as_py()), np.flatnonzero(block == group["j"][0].as_py())
        within = group["i"][0].as_py() == group["j"][0].as_py()
        links = np.zeros((len(left), len(right)), bool)
        for a in range(0, len(left), 512):
            links[a : a + 512] = v[left[a : a + 512]] @ v[right].T >= cosine
        if within:
            np.fill_diagonal(links, False)
        p, q = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
        out = pa.schema([("uid", pa.int64()), ("n_links", pa.int64()), ("least", pa.int64())])
        if not len(p):
            return out.empty_table()
        links, left, right = links[np.ix_(p, q)], left[p], right[q]
        # Earlier leaves that two vectors share: the pair was counted there.
        use = np.union1d(left, right)
        own = [[x for x in leaves if x < leaf] for leaves in group["leaves"].take(pa.array(use)).to_pylist()]
        names = {x: k for k, x in enumerate(sorted({x for leaves in own for x in leaves}))}
        member = np.zeros((len(uid), len(names)), np.float32)
        for r, leaves in zip(use, own, strict=True):
            member[r, [names[x] for x in leaves]] = 1
        for a in range(0, len(left), 512):
            links[a : a + 512] &= member[left[a : a + 512]] @ member[right].T < 0.5
        count = np.zeros(len(uid), np.int64)
        count[left] += (links * weight[right][None, :]).sum(1) if len(right) else 0
        if not within:
            count[right] += (links * weight[left][:, None]).sum(0)
        least = uid.copy()
        while True:  # smallest id along the links counted here
            before = least.copy()
            for a in range(0, len(left), 512):
                some = links[a : a + 512]
                reach = np.where(some, least[right][None, :], np.iinfo(np.int64).max)
                least[left[a : a + 512]] = np.minimum(least[left[a : a + 512]], reach.min(1))
                back = np.where(some, least[left[a : a + 512]][:, None], np.iinfo(np.int64).max).min(0)
                np.minimum.at(least, right, back)
            if (least == before).all():
                break
        some = np.flatnonzero(count)
        return pa.Table.from_arrays([pa.array(uid[some]), pa.array(count[some]), pa.array(least[some])], schema=out)

    return compare


ROUTE = "uid long, vec binary, leaf long, open boolean"


def _deepen(placed: DataFrame, cosine: float, kind: str, dim: int, leaf: int,
            sample: int) -> tuple[DataFrame, DataFrame] | None:
    """The open leaves in ``placed`` that are too large, and their vectors (uid, vec, leaf, open) one level of subtrees on.

    None if there is no such leaf. Rows are streamed past their leaf's subtree, a hot leaf in several tasks.
    """
    counts = placed.filter("open").groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * leaf)
    counts = materialize(counts, "open")
    if counts.isEmpty():
        return None
    rows = placed.select("uid", "vec", "leaf").join(one_per_key(counts, "leaf"), "leaf")
    share = F.pmod(F.xxhash64("uid", "leaf"), F.lit(1 << 30)) / F.lit(1 << 30)

    def grow(group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        own, rows = group["leaf"][0].as_py(), group["n"][0].as_py()
        v = unit(np.frombuffer(b"".join(group["vec"].to_pylist()), kind).reshape(group.num_rows, dim))
        tree = Forest(v, rows, cosine, 1, leaf, seed=own % (1 << 63))
        return pa.table({"leaf": pa.array([own], pa.int64()), "n": pa.array([rows], pa.int64()),
                         "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    drawn = rows.filter(share <= F.lit(float(sample)) / F.col("n")).select("leaf", "n", "vec", "uid")
    trees = materialize(drawn.groupBy("leaf").applyInArrow(grow, "leaf long, n long, tree binary"), "subtrees")
    parts = F.ceil(F.col("n") / ROUTED).cast("int")
    both = rows.select("leaf", F.pmod(F.xxhash64("uid"), parts).cast("int").alias("part"), "uid", "vec",
                       F.lit(None).cast("binary").alias("tree"))
    both = both.unionByName(trees.select(
        "leaf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("long").alias("uid"),
        F.lit(None).cast("binary").alias("vec"), "tree"))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, parent = None, None
        for batch in batches:
            heads = np.flatnonzero(batch["tree"].is_valid().to_numpy(zero_copy_only=False))
            edges = np.union1d([0, batch.num_rows], heads).astype(int).tolist()
            for a, b in zip(edges, edges[1:]):
                if batch["tree"][a].is_valid:
                    tree, parent = pickle.loads(batch["tree"][a].as_py()), batch["leaf"][a].as_py()
                    names = [xxhash.xxh3_64_intdigest(f"{parent} {k}") - (1 << 63) for k in range(tree.leaves)]
                    a += 1
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                v = unit(np.frombuffer(b"".join(part["vec"].to_pylist()), kind).reshape(part.num_rows, dim))
                leaves = tree.route(v)
                at = np.repeat(np.arange(part.num_rows), [len(x) for x in leaves])
                own = np.concatenate(leaves).tolist()
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [part["uid"].take(take), part["vec"].take(take), pa.array([names[k] for k in own], pa.int64()),
                     pa.array([k in tree.open for k in own], pa.bool_())], names=["uid", "vec", "leaf", "open"])

    # The subtree's row, whose uid is null, comes before its vectors.
    streamed = both.repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.asc_nulls_first("uid"))
    return counts, materialize(streamed.mapInArrow(route, ROUTE), "deeper")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, trees: int = TREES, leaf: int = LEAF,
                    sample: int = SAMPLE, block: int = BLOCK, subsample: int = SUBSAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows, kind, dim = _prepared(vectors)
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("uid").alias("uid"), F.count("*").alias("weight"))
    classes = materialize(classes, "classes")
    reps = rows.join(classes, ["key", "uid"]).select("uid", "weight", "vec")
    total = classes.count()
    some = reps.select("uid", "vec").orderBy(F.xxhash64("uid"), "uid").limit(sample).select("vec").toArrow()["vec"].to_pylist()
    if not some:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    forest = spark.sparkContext.broadcast(  # bounded by the sample
        Forest(unit(np.frombuffer(b"".join(some), kind).reshape(len(some), dim)), total, cosine, trees, leaf))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit(np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(batch.num_rows, dim))
            leaves = forest.value.route(v)
            some = [[x for x in own if x in forest.value.open] for own in leaves]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaves, pa.list_(pa.int64())), pa.array(some, pa.list_(pa.int64()))],
                names=["uid", "weight", "vec", "leaves", "open"])

    routed = materialize(reps.mapInArrow(route, "uid long, weight long, vec binary, leaves array<long>, open array<long>"), "routed")
    level = routed.select("uid", "vec", F.explode("open").alias("leaf"), F.lit(True).alias("open"))
    final, deeper = routed.select("uid", F.explode("leaves").alias("leaf")), False
    while (step := _deepen(level, cosine, kind, dim, leaf, subsample)) is not None:
        split, level = step  # a leaf with a subtree gives way to that subtree's leaves
        final = final.join(split.select("leaf"), "leaf", "left_anti").unionByName(level.select("leaf", "uid"))
        deeper = True
    if deeper:
        final = final.groupBy("uid").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
        routed = materialize(routed.drop("leaves", "open").join(final, "uid"), "routed")
    placed = routed.withColumn("leaf", F.explode("leaves"))
    blocks = placed.groupBy("leaf").agg(F.count("*").alias("n"))
    blocks = blocks.filter("n > 1").select("leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(blocks), "leaf").withColumn(
        "block", F.pmod(F.xxhash64("uid", "leaf"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("uid", "weight", "vec", "leaves", "leaf", "block",
                           F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = placed.groupBy("leaf", "i", "j").applyInArrow(_compare(cosine, kind, dim), "uid long, n_links long, least long")
    found = materialize(found, "links")
    counted = found.groupBy("uid").agg(F.sum("n_links").alias("n_links"))
    labels = components(found.select(F.col("uid").alias("a"), F.col("least").alias("b")))

    groups = (classes.join(counted, "uid", "left").join(labels.withColumnRenamed("id", "uid"), "uid", "left")
              .select("key", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                      F.coalesce("root", "uid").alias("root")))
    out = rows.select("vec_id", "key", "uid").join(groups, "key", "left")
    out = out.withColumn("root", F.coalesce("root", "uid"))
    least = out.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.join(least, "root").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                          "component_id", kept.alias("kept"))
