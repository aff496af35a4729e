"""Collapse duplicate and cascading errors.

The unit of work is the *template group*: all events of a run that normalise to
the same text. Groups are built with one aggregate, whose map-side half already
folds a hot run or a hot template into a single row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, templates
from ..sources.model import RUN_KEY, run_key
from .skew import one_per_key

EVENT_FIELDS = ("seq", "severity", "message", "source", "code")


def template_groups(events: DataFrame, counters: bool = False) -> DataFrame:
    """First error event and event count per (run, template).

    With ``counters`` the non-error rows stay in as one group per run without a
    template, so that redaction hits are summed in the same pass over the log.
    """
    error = parsing.is_error(F.col("severity"))
    if not counters:
        events = events.filter(error)
    event = F.struct(*EVENT_FIELDS)
    aggs = [
        F.min_by(F.when(error, event), F.when(error, F.col("seq"))).alias("event"),
        F.count("*").alias("n_events"),
    ]
    if counters:
        aggs.append(F.sum("n_hits").cast("bigint").alias("n_hits"))
    grouped = (
        events.withColumn(
            "template", F.when(error, templates.normalize_template(F.col("message"))))
        .groupBy("run_id", "platform", "template")
        .agg(*aggs)
    )
    return grouped.withColumn("cascade", templates.is_cascade(F.col("event.message")))


def dedup_errors(events: DataFrame) -> DataFrame:
    """Meaningful errors: the first event per template without the cascades;
    where a run has nothing but cascades, its first event per template."""
    groups = template_groups(events)
    causes = groups.groupBy(*RUN_KEY).agg(F.max(~F.col("cascade")).alias("has_cause"))
    kept = groups.join(one_per_key(causes, *RUN_KEY), RUN_KEY).filter(~F.col("cascade") | ~F.col("has_cause"))
    return kept.select(
        "run_id", "platform", "template", "n_events", "cascade", "has_cause",
        *[F.col(f"event.{f}").alias(f) for f in EVENT_FIELDS])


def dedup_counters(groups: DataFrame) -> DataFrame:
    """Removed duplicates and cascades per run with errors."""
    own = run_key(groups)
    per_run = groups.filter(F.col("event").isNotNull()).groupBy(*own).agg(
        F.sum("n_events").alias("errors"),
        F.count("*").alias("templates"),
        F.count(F.when(F.col("cascade"), 1)).alias("cascades"),
    )
    return per_run.select(
        *own,
        F.col("errors").cast("bigint").alias("errors"),
        "templates",
        (F.col("errors") - F.col("templates")).cast("bigint").alias("removed_duplicates"),
        F.when(F.col("cascades") == F.col("templates"), F.lit(0)).otherwise(F.col("cascades"))
        .cast("bigint").alias("removed_cascades"),
    )
