"""Signature matching, classification and the earliest meaningful failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.signatures import with_matches
from ..sources.model import RUN_KEY
from .rules import indexed_matches

INDEX_FROM = 64  # lists longer than this are looked up by literal; the matches are the same


def _long(signatures: list[tuple] | None) -> bool:
    return signatures is not None and len(signatures) > INDEX_FROM


def signature_match(meaningful: DataFrame, signatures: list[tuple] | None = None) -> DataFrame:
    """One row per (event, signature) match over the meaningful errors."""
    known = meaningful.select("run_id", "platform", "seq", "message", "code")
    if _long(signatures):
        return indexed_matches(known, "message", "platform", "code", signatures).select("run_id", "platform", "seq", "m.*")
    return with_matches(known, "message", "platform", "code", signatures).select(
        "run_id", "platform", "seq", F.explode("matches").alias("m")).select("run_id", "platform", "seq", "m.*")


def triage_runs(groups: DataFrame, signatures: list[tuple] | None = None) -> DataFrame:
    """One row per run: counters, ranked categories, earliest failure.

    ``groups`` comes from ``template_groups(counters=True)``. Signatures run
    once, on first-per-template events. Two aggregates follow, both with
    map-side halves: by (run, cascade, category), then by run, where a run has
    at most two rows per category of the fixed taxonomy. Whether a run falls
    back to its cascades is decided at the end from the same rows, so no join
    and no per-run window is needed.
    """
    kept = ["run_id", "platform", "n_events", "n_hits", "event", "cascade"]
    found = "event.message", "platform", "event.code", signatures
    if _long(signatures):  # each group once without a match, and once per match
        matches = indexed_matches(groups.select(*kept), *found).withColumn("pos", F.lit(1))
        matched = matches.unionByName(groups.select(*kept, F.lit(0).alias("pos")), allowMissingColumns=True)
    else:
        matched = with_matches(groups.select(*kept), *found).select(*kept, F.posexplode_outer("matches").alias("pos", "m"))

    lead = "coalesce(pos, 0) = 0"                        # once per group
    error = f"{lead} and event is not null"
    by_category = matched.groupBy(
        "run_id", "platform", "cascade", F.col("m.category").alias("category")
    ).agg(*map(F.expr, (
        "sum(m.weight) as weight",
        "count(m.weight) as matches",
        "min(struct(event.seq as seq, m.sig_ord as sig_ord)) as first_seen",
        f"""min(struct(event.seq as seq, m.sig_ord as sig_ord, event.message as message,
                       event.source as source, m.title as title, m.token as token,
                       m.code as code)) filter (where m.weight >= {fixed.STRONG_WEIGHT}) as strong""",
        f"""min(struct(event.seq as seq, event.message as message, event.source as source))
            filter (where {error}) as first""",
        f"sum(n_events) filter (where {error}) as errors",
        f"count_if({error}) as templates",
        f"sum(n_hits) filter (where {lead}) as hits",
    )))

    per_run = by_category.groupBy("run_id", "platform").agg(*map(F.expr, (
        "coalesce(sum(hits), 0) as hit_count",
        "coalesce(sum(errors), 0) as errors",
        "sum(templates) as templates",
        "coalesce(sum(templates) filter (where cascade), 0) as cascades",
        "min(first) filter (where not cascade) as cause_first",
        "min(first) filter (where cascade) as echo_first",
        "min(strong) filter (where not cascade) as cause_strong",
        "min(strong) filter (where cascade) as echo_strong",
        """collect_list(struct(cascade, -weight as order, first_seen, category, weight, matches))
           filter (where category is not null) as found""",
    )))

    chosen = per_run.selectExpr(
        "*",
        "templates > 0 and templates = cascades as fallback",
        "if(fallback, echo_strong, cause_strong) as strong",
        "if(fallback, echo_first, cause_first) as first",
        "sort_array(filter(found, c -> c.cascade = fallback)) as ranked",
        "try_element_at(ranked, 1) as top",
    )
    return chosen.selectExpr(
        "run_id", "platform", "hit_count", "errors", "fallback", "templates",
        "errors - templates as removed_duplicates",
        "if(fallback, 0L, cascades) as removed_cascades",
        "if(fallback, templates, templates - cascades) as meaningful",
        """transform(ranked, c -> named_struct('category', c.category, 'weight', c.weight,
                                               'matches', c.matches)) as categories""",
        "coalesce(top.category, 'unknown') as category",
        f"""case when top.weight is null then 0D
                 else least(1D, top.weight / 100D / {fixed.SCORE_SATURATION}D) end as class_score""",
        "coalesce(strong.seq, first.seq) as earliest_seq",
        "coalesce(strong.message, first.message) as earliest_message",
        "if(strong is not null, strong.source, first.source) as earliest_source",
        """case when strong is not null then 'signature' when fallback then 'first_error'
                when first is not null then 'first_non_cascade_error' end as reason""",
        "strong.title as match_title", "strong.token as token", "strong.code as match_code",
    )


def classify_by_category(triage: DataFrame) -> DataFrame:
    """Ranked categories per run: weight in hundredths, match count, rank."""
    return triage.select(*RUN_KEY, F.posexplode("categories").alias("pos", "c")).select(
        *RUN_KEY, (F.col("pos") + 1).alias("rank"), "c.category", "c.weight", "c.matches")
