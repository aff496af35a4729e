"""Connected components of links held as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import release
from faultline.operators.skew import one_per_key
from faultline.storage import materialize


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, root) for every id of ``links`` (a, b): root is the smallest id reachable.

    ``labels``: such rows for links known before; then only links between
    different roots are followed, and the rows returned cover both.

    Alternates two star steps: every larger neighbour of an id is linked to the
    id's smallest neighbour, then every id and its smaller neighbours are. A
    round is a map-side aggregate and a join; each is written to shared storage,
    so a lost executor costs one round. It ends when the links are stars,
    after about the logarithm of the longest path. Links with a null end are
    none; an id linked with itself alone gets no row; without links there are no rows.
    """
    if labels is not None:
        for end in ("a", "b"):
            links = links.join(labels.select(F.col("id").alias(end), "root"), end, "left")
            links = links.withColumn(end, F.coalesce("root", end)).drop("root")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = materialize(edges, "edges", narrow=True)
    while not _stars(edges):
        release(links.sparkSession)
        down, up = edges.select("u", "v"), edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = down.union(up).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = up.join(one_per_key(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(one_per_key(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        edges = materialize(small, "edges", narrow=True)
    roots = edges.select(F.col("v").alias("id")).distinct()
    found = (edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
             .union(roots.select("id", F.col("id").alias("root"))))
    if labels is None:
        return materialize(found, "labels", narrow=True)
    later = found.select(F.col("id").alias("root"), F.col("root").alias("later"))
    moved = labels.join(later, "root", "left").select("id", F.coalesce("later", "root").alias("root"))
    return materialize(moved.union(found.join(labels, "id", "left_anti").select("id", "root")), "labels", narrow=True)


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is itself a u."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.filter("below > 1 or (below > 0 and above > 0)").isEmpty()
