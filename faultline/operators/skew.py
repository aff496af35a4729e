"""Joins of a large side with hot keys against one row per key, and of sides whose size the planner can't see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(side: DataFrame, *keys: str) -> DataFrame:
    """Prepare the unique side of a join on ``keys``.

    Adaptive execution splits a hot key only where both sides enter the join
    through the join's own shuffle. An aggregate on the same keys needs none,
    so the hot key would stay in one task. Spreading the (small, one row per
    key) aggregate by a derived hash makes the join shuffle it, and the other
    side can be split.
    """
    return side.repartition(F.xxhash64(*keys))


def shuffled(side: DataFrame) -> DataFrame:
    """Join ``side`` by shuffle and sort, whatever size is guessed for it and for the side it meets.

    The planner guesses from the bytes of a compressed file and knows nothing of the rows that an
    explode adds, so a side without a bound can pass for a small one and be sent through the driver.
    """
    return side.hint("merge")
