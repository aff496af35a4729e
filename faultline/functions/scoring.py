"""Scores and confidence levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def class_score(weight: Column) -> Column:
    """Summed signature weight (hundredths) -> 0..1."""
    return F.when(weight.isNull(), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), weight / F.lit(100.0) / F.lit(fixed.SCORE_SATURATION)))


def confidence_sql(score: str) -> str:
    return (f"case when {score} >= {fixed.HIGH_CONFIDENCE}D then 'high' "
            f"when {score} >= {fixed.MEDIUM_CONFIDENCE}D then 'medium' else 'low' end")


def confidence_bucket(score: str) -> Column:
    return F.expr(confidence_sql(score))


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in fixed.CONFIDENCE_RANK.items():
        out = F.when(confidence == name, F.lit(rank)).otherwise(out)
    return out
