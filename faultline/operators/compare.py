"""Compare a failed run with its baseline run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, templates
from ..sources.model import run_key
from ..storage import materialize
from .skew import one_per_key

DEPENDENCY_KINDS = ("dependencies", "libraries")
ENVIRONMENT_KINDS = ("environment", "runtime")
SECTION_ORDER = {"parameters": 1, "dependencies": 2, "configuration": 3, "environment": 4}


def baseline_link(runs: DataFrame) -> DataFrame:
    """(platform, run_id, baseline_id) where the declared baseline exists on the platform."""
    known = runs.select(F.col("run_id").alias("baseline_id"), "platform")
    shared = [c for c in runs.columns if c == "shares_metadata"]
    return runs.filter(F.col("baseline_id").isNotNull()).select(
        "run_id", "baseline_id", "platform", *shared
    ).join(known, ["baseline_id", "platform"]).select("platform", "run_id", "baseline_id", *shared)


def run_entries(runs: DataFrame, configs: DataFrame | None) -> DataFrame:
    """Parameters and configuration snapshots as (run, section, key) entries.

    Environment kinds appear in their own section and, prefixed with the kind,
    in ``configuration``; dependency kinds only in theirs.
    """
    own = run_key(runs)
    parameters = runs.filter(F.col("parameters").isNotNull()).select(
        *own, F.lit(0).alias("ord"), F.explode("parameters").alias("key", "value")
    ).select(*own, "ord", F.lit("parameters").alias("section"), "key", "value")
    if configs is None:
        return parameters
    if run_key(configs) != own:  # snapshots without a platform belong to the runs of that id
        configs = configs.join(runs.select(*own), "run_id")
    flat = configs.select(*own, "ord", "kind", F.explode("values").alias("key", "value"))
    dependency = F.col("kind").isin(*DEPENDENCY_KINDS)
    sections = F.array_compact(F.array(
        F.when(dependency, F.struct(F.lit("dependencies").alias("section"), F.col("key"))),
        F.when(F.col("kind").isin(*ENVIRONMENT_KINDS),
               F.struct(F.lit("environment").alias("section"), F.col("key"))),
        F.when(~dependency, F.struct(
            F.lit("configuration").alias("section"),
            F.concat_ws(".", F.col("kind"), F.col("key")).alias("key"))),
    ))
    settings = flat.select(*own, "ord", "value", F.explode(sections).alias("s")).select(
        *own, "ord", "s.section", "s.key", "value")
    return parameters.unionByName(settings)


def diff_records(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys whose value differs between a run and its baseline, per section.

    A full outer comparison as one aggregate: both sides are tagged, unioned
    and folded by (run, section, key). The same pass lets a later snapshot
    (higher ``ord``) override an earlier one. A pair with ``shares_metadata`` has
    nothing to compare.
    """
    if "shares_metadata" in pairs.columns:
        pairs = pairs.filter(~F.coalesce("shares_metadata", F.lit(False))).drop("shares_metadata")
    own = run_key(entries)
    other = [c for c in own if c != "run_id"] + ["baseline_id"]
    after = entries.join(pairs.select(*own), own).select(
        *own, "section", "key",
        F.col("ord").alias("after_ord"), F.col("value").alias("after_value"),
        F.lit(None).cast("int").alias("before_ord"),
        F.lit(None).cast("string").alias("before_value"))
    before = entries.withColumnRenamed("run_id", "baseline_id").join(pairs, other).select(
        *own, "section", "key",
        F.lit(None).cast("int").alias("after_ord"),
        F.lit(None).cast("string").alias("after_value"),
        F.col("ord").alias("before_ord"), F.col("value").alias("before_value"))
    return (
        after.unionByName(before)
        .groupBy(*own, "section", "key")
        .agg(F.max_by("before_value", "before_ord").alias("before"),
             F.max_by("after_value", "after_ord").alias("after"))
        .filter(~F.col("before").eqNullSafe(F.col("after")))
    )


def new_errors(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Error messages of a run whose template its baseline never logged.

    Reads the undeduplicated stream: cascades count, and each distinct message
    is reported once at its first position. Messages are folded before their
    templates are computed and before anything is joined. A run is looked up
    both as itself and as a baseline: the folded messages, few beside the log,
    are written once, so the log is read once. Only templates are looked up in
    a baseline, so one that many runs share is not repeated for each.
    """
    own = run_key(events)
    other = [c for c in own if c != "run_id"] + ["baseline_id"]
    messages = materialize(
        events.filter(parsing.is_error(F.col("severity")))
        .groupBy(*own, "message").agg(F.min("seq").alias("seq"))
        .withColumn("template", templates.normalize_template(F.col("message"))), "error_messages")
    known = messages.withColumnRenamed("run_id", "baseline_id").select(*other, "template").distinct()
    return messages.join(one_per_key(pairs.select(*own, "baseline_id"), *own), own).join(
        one_per_key(known, *other, "template"), [*other, "template"], "left_anti"
    ).select(*own, "seq", "message")
