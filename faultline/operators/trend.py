"""Row-count and latency outliers against earlier runs of a pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metric_regression(metrics: DataFrame, runs_back: int = 7, threshold: float = 3.0) -> DataFrame:
    """z-score of each period against the ``runs_back`` periods before it.

    ``metrics``: (pipeline, period, value), one row per period. Aggregate runs
    to periods first; that bounds the rows of a pipeline by the calendar.
    """
    before = Window.partitionBy("pipeline").orderBy("period").rowsBetween(-runs_back, -1)
    return metrics.select(
        "pipeline", "period", "value",
        F.count("value").over(before).alias("history"),
        F.avg("value").over(before).alias("mean"),
        F.stddev_samp("value").over(before).alias("deviation"),
    ).withColumn("z_score", F.when(
        F.col("deviation") > 0, (F.col("value") - F.col("mean")) / F.col("deviation"))
    ).withColumn("outlier", F.coalesce(F.abs("z_score") >= F.lit(threshold), F.lit(False)))
