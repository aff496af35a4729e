"""From runs and log events to ranked, evidence-labelled hypotheses."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, parsing, redaction, scoring
from ..functions.scoring import confidence_sql
from ..functions.signatures import label_sql
from ..functions.text import short_id
from ..operators import classify, compare, correlate, dedup
from ..operators.skew import shuffled
from ..sources.model import RUN_KEY, SOURCE_REF_TYPE, source_ref
from ..storage import drop_shuffles, materialize

#: Rows of a kind that a hypothesis lists; ``None`` lists all of them.
DEPENDENCY_EVIDENCE = 5
PARAMETER_EVIDENCE = 5
ISSUE_EVIDENCE = 3
ALTERNATES = 2


@dataclass(frozen=True)
class Investigation:
    """Lazy result tables of one bulk investigation, all keyed by (``platform``, ``run_id``)."""

    scored: DataFrame          # one row per run: everything the score rests on
    diff: DataFrame            # run, section, key, before, after
    closest: DataFrame | None  # run, n_related, the most similar issues
    issues: DataFrame | None
    pairs: DataFrame
    seeds: DataFrame | None = None       # run, token: the search text of each run
    changes: DataFrame | None = None
    errors: DataFrame | None = None      # the redacted log events
    min_similarity: float = fixed.MIN_SIMILARITY

    def staged(self) -> Investigation:
        """With the scored runs and the diff written once; for callers that
        read several of the result tables."""
        return replace(self, scored=materialize(self.scored, "scored"),
                       diff=materialize(self.diff, "diff"))

    def hypotheses(self, alternates: int | None = ALTERNATES) -> DataFrame:
        return build_hypotheses(self.scored, alternates)

    def evidence(self, dependencies: int | None = DEPENDENCY_EVIDENCE,
                 parameters: int | None = PARAMETER_EVIDENCE,
                 issues: int | None = ISSUE_EVIDENCE,
                 alternates: int | None = ALTERNATES) -> DataFrame:
        """All evidence. The limits are those of a report; without them every row is listed, ranked by ``ord``."""
        return build_evidence(self.scored, self.diff, self.ranked_issues(issues), self.issues,
                              dependencies, parameters, alternates)

    @property
    def related(self) -> DataFrame | None:
        """run, issue_key, similarity: all pairs; only reports without limits need them."""
        if self.seeds is None:
            return None
        return correlate.similar_incidents(self.seeds, self.issues, self.min_similarity)

    def ranked_issues(self, limit: int | None = ISSUE_EVIDENCE) -> DataFrame | None:
        """run, n (from 1), issue_key, similarity: the most similar issues of each run, or all of them."""
        if self.closest is None:
            return None
        if limit is not None and limit <= ISSUE_EVIDENCE:
            return self.closest.select(*RUN_KEY, F.explode("top").alias("t")).select(
                *RUN_KEY, F.col("t.rank").alias("n"), "t.issue_key", "t.similarity").filter(F.col("n") <= limit)
        pairs = self.related
        order = Window.partitionBy(*RUN_KEY).orderBy(F.desc("similarity"), "ord", "issue_key")
        ranked = pairs.join(shuffled(self.issues.select(F.col("key").alias("issue_key"), "ord")), "issue_key") \
            .withColumn("n", F.row_number().over(order)).drop("ord")
        return ranked if limit is None else ranked.filter(F.col("n") <= limit)

    def recommendations(self) -> DataFrame:
        return recommend(self.hypotheses())

    def incidents(self) -> DataFrame:
        return build_incidents(self.scored)


# --- scoring ----------------------------------------------------------------

def score_runs(runs: DataFrame, triage: DataFrame, found: DataFrame | None,
               diff: DataFrame, closest: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """Join what is known per run and compute score and confidence.

    Every input has at most one row per run, so no join multiplies rows.
    """
    changed = diff.groupBy(*RUN_KEY).agg(
        F.expr("count_if(section = 'dependencies') as changed_dependencies"),
        F.expr("count_if(section = 'parameters') as changed_parameters"))
    base = runs.join(shuffled(triage), RUN_KEY, "left").join(changed, RUN_KEY, "left") \
        .join(pairs.selectExpr(*RUN_KEY, "true as paired"), RUN_KEY, "left")
    kinds = {"change_id": "string", "change_kind": "string", "change_title": "string",
             "predates": "boolean", "change_ref": SOURCE_REF_TYPE}
    change = [c if found is not None and c in found.columns else f"cast(null as {kind}) as {c}"
              for c, kind in kinds.items()]
    if found is not None:
        base = base.join(found.drop("token"), RUN_KEY, "left")
    issue_count = "0L as related_issues"
    if closest is not None:
        base = base.join(shuffled(closest.select(*RUN_KEY, "n_related")), RUN_KEY, "left")
        issue_count = "coalesce(n_related, 0L) as related_issues"
    counters = ["hit_count", "errors", "templates", "removed_duplicates", "removed_cascades",
                "meaningful", "changed_dependencies", "changed_parameters"]
    known = base.selectExpr(
        *runs.columns, "categories", "earliest_seq", "earliest_message", "earliest_source",
        "reason", "match_title", "token", "match_code", "paired is not null as compared",
        "coalesce(category, 'unknown') as category", "coalesce(class_score, 0D) as class_score",
        *[f"coalesce({c}, 0L) as {c}" for c in counters], *change, issue_count)
    # bonuses in a fixed order, capped after each
    return known.selectExpr(
        "*",
        f"if(change_id is not null, least(1D, class_score + {fixed.CHANGE_BONUS}D), class_score)"
        " as with_change",
        "if(compared and startswith(category, 'deps.') and changed_dependencies > 0, "
        f"least(1D, with_change + {fixed.DEPENDENCY_BONUS}D), with_change) as with_dependency",
        f"if(related_issues > 0, least(1D, with_dependency + {fixed.ISSUE_BONUS}D), "
        "with_dependency) as raw_score",
    ).drop("with_change", "with_dependency")


def investigate(runs: DataFrame, events: DataFrame, *, configs: DataFrame | None = None,
                changes: DataFrame | None = None, issues: DataFrame | None = None,
                correlate_evidence: bool = True, level: str = "strict",
                min_similarity: float = fixed.MIN_SIMILARITY,
                signatures: list[tuple] | None = None) -> Investigation:
    """Investigate every run.

    ``events`` are parsed, unredacted log events. They are redacted first and
    exactly once; all later steps see redacted text. What has two consumers is
    written once: the redacted events (triage and issue search; messages of
    error events only) and the per-run triage (the runs and their tokens).
    """
    redacted = redaction.redact_log_events(events, level)
    search_issues = correlate_evidence and issues is not None
    if search_issues:
        error = parsing.is_error(F.col("severity"))
        redacted = materialize(redacted.select(
            "run_id", "platform", "seq", "severity", F.when(error, F.col("message")).alias("message"),
            "source", "code", "n_hits"), "log_events")
    triage = classify.triage_runs(dedup.template_groups(redacted, counters=True), signatures)
    if correlate_evidence and changes is not None:
        triage = materialize(triage, "triage")
        drop_shuffles(runs.sparkSession)

    pairs = compare.baseline_link(runs)
    diff = compare.diff_records(compare.run_entries(runs, configs), pairs)

    found = closest = seeds = None
    if correlate_evidence and changes is not None:
        tokens = triage.filter(F.col("token").isNotNull()).select(*RUN_KEY, "token").join(
            shuffled(runs.select(*RUN_KEY, "started_at")), RUN_KEY)
        found = correlate.change_correlate(tokens, changes)
    if search_issues:
        seeds = materialize(correlate.seed_tokens(runs, redacted), "seeds")
        drop_shuffles(runs.sparkSession)
        closest = materialize(correlate.related_issues(seeds, issues, ISSUE_EVIDENCE, min_similarity), "closest")
        drop_shuffles(runs.sparkSession)
    scored = score_runs(runs, triage, found, diff, closest, pairs)
    return Investigation(scored, diff, closest, issues if search_issues else None, pairs, seeds,
                         changes if correlate_evidence else None, redacted, min_similarity)


# --- hypotheses -------------------------------------------------------------

def _alternate_sql(weight: str) -> str:
    return f"least({fixed.ALTERNATE_CAP}D, {weight} / 100D / {fixed.ALTERNATE_DIVISOR}D)"


def _seconds(alternates: int | None) -> str:
    """The categories behind the first, ``alternates`` of them or all; a run has at most one per category."""
    count = "greatest(size(categories) - 1, 0)" if alternates is None else str(int(alternates))
    return (f"filter(slice(categories, 2, {count}), c -> {_alternate_sql('c.weight')} >= "
            f"{fixed.ALTERNATE_FLOOR}D)")


def _hypothesis_sql(ord_: str, seed: str, category: str, title: str, rationale: str,
                    score: str) -> str:
    return (f"named_struct('order', -round({score}, 3), 'ord', {ord_}, "
            f"'seed', {seed}, 'category', {category}, 'title', {title}, "
            f"'rationale', {rationale}, 'confidence', {confidence_sql(score)}, "
            f"'score', round({score}, 3))")


def ranked_hypotheses(alternates: int | None = ALTERNATES) -> Column:
    """Array per scored run: the primary and its alternates, best first; ``seed`` makes a hypothesis's id."""
    label, other = label_sql("category"), label_sql("c.category")
    primary = _hypothesis_sql(
        "0", "concat('h-primary', category, coalesce(token, ''))", "category",
        f"coalesce(match_title, {label})",
        f"""if(earliest_seq is not null,
               concat('The earliest meaningful failure matches the ', {label},
                      ' pattern; later log lines are downstream effects.'),
               concat('Classification derived from aggregate error signatures (', {label}, ').'))""",
        "raw_score")
    alternate = _hypothesis_sql(
        "i + 1", "concat('h-alt', c.category)", "c.category", other,
        f"concat('Secondary signal: ', c.matches, ' matching signature(s) for ', {other}, '.')",
        _alternate_sql("c.weight"))
    return F.expr(f"sort_array(concat(array({primary}), "
                  f"transform(coalesce({_seconds(alternates)}, array()), (c, i) -> {alternate})))")


def build_hypotheses(scored: DataFrame, alternates: int | None = ALTERNATES) -> DataFrame:
    """One row per hypothesis."""
    return scored.select(
        *RUN_KEY, F.posexplode(ranked_hypotheses(alternates)).alias("pos", "h"), "match_code",
    ).select(
        *RUN_KEY, (F.col("pos") + 1).alias("rank"), (F.col("h.ord") == 0).alias("is_primary"),
        short_id("h.seed").alias("hypothesis_id"), "h.category", "h.title", "h.rationale", "h.confidence", "h.score",
        F.when(F.col("h.ord") == 0, F.col("match_code")).alias("code"))


def knowledge(spark: SparkSession) -> DataFrame:
    """Guidance of every category; a dimension of fixed size, safe to broadcast."""
    rows = []
    for category in fixed.CATEGORY_LABELS:
        verify, remediate = fixed.KNOWLEDGE.get(category, fixed.GENERIC_KNOWLEDGE)
        steps = [("verification", t, False) for t in verify] + \
                [("remediation", t, True) for t in remediate]
        rows += [(category, i, kind, text, mutates) for i, (kind, text, mutates) in enumerate(steps)]
    dim = spark.createDataFrame(
        rows, "category string, ord int, kind string, description string, mutates boolean")
    return dim.withColumn("recommendation_id",
                          short_id("concat(substring(kind, 1, 1), description)"))


def recommend(hypotheses: DataFrame) -> DataFrame:
    dim = knowledge(hypotheses.sparkSession)
    return hypotheses.select(*RUN_KEY, "rank", "category").join(F.broadcast(dim), "category")


# --- evidence ---------------------------------------------------------------

#: Where each kind stands within a hypothesis.
_DEPENDENCIES, _PARAMETERS, _BASELINE, _ISSUES = (k * 1_000_000_000 for k in range(1, 5))


def _evidence(ord_, kind, statement, seed, log_seq=None, url=None, code=None, ref=None) -> Column:
    return F.struct(
        ord_.cast("bigint").alias("ord"), F.lit(kind).alias("kind"), statement.alias("statement"),
        (F.lit(None) if log_seq is None else log_seq).cast("bigint").alias("log_seq"),
        seed.alias("seed"),
        (F.lit(None) if url is None else url).cast("string").alias("url"),
        (F.lit(None) if code is None else code).cast(parsing.CODE_REF_TYPE).alias("code"),
        (F.lit(None) if ref is None else ref).cast(SOURCE_REF_TYPE).alias("source_ref"))


def _change_text(noun: str) -> Column:
    absent = F.lit("(absent)")
    return F.concat(F.lit(noun + " "), F.col("key"), F.lit(" changed "),
                    F.coalesce("before", absent), F.lit(" → "), F.coalesce("after", absent),
                    F.lit(" vs. last success."))


def _top_changes(diff: DataFrame, section: str, limit: int | None) -> DataFrame:
    """Ranked keys per run. A limit is applied before the shuffle too
    (window group limit), so a run with very many keys ships only ``limit``."""
    order = Window.partitionBy(*RUN_KEY).orderBy(F.lower("key"), "key")
    ranked = diff.filter(F.col("section") == section).withColumn("n", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("n") <= limit)


def evidence_from_run(scored: DataFrame) -> DataFrame:
    """Evidence that needs the scored run only: the earliest error, the change
    that mentions the token (or that none does), a missing baseline, and one
    line per alternate hypothesis."""
    token = F.col("token")
    items = F.array_compact(F.array(
        F.when(F.col("earliest_seq").isNotNull(), _evidence(
            F.lit(0), "confirmed",
            F.concat(F.lit("Earliest meaningful error (line "),
                     F.col("earliest_seq").cast("string"), F.lit("): "),
                     F.col("earliest_message")),
            F.concat(F.lit("e-earliest"), F.col("earliest_seq").cast("string")),
            log_seq=F.col("earliest_seq"), code=F.col("match_code"))),
        F.when(F.col("change_id").isNotNull(), _evidence(
            F.lit(1), "strong_correlation",
            F.concat(F.col("change_kind"), F.lit(' "'), F.col("change_title"),
                     F.lit('" references "'), token, F.lit('" and predates the failed run.')),
            F.concat(F.lit("e-change"), F.col("change_id")), ref=F.col("change_ref"),
            url=F.col("change_ref.url"))),
        F.when(F.col("change_id").isNull() & token.isNotNull(), _evidence(
            F.lit(1), "inference",
            F.concat(F.lit('Failure centers on "'), token,
                     F.lit('"; no correlated change was found in connected systems.')),
            F.concat(F.lit("e-token"), token))),
        F.when(~F.col("compared"), _evidence(
            F.lit(_BASELINE), "missing_information",
            F.lit("No successful baseline run was supplied; cross-run comparison was skipped."),
            F.lit("e-nobaseline"))),
    ))
    return scored.select(*RUN_KEY, "category", items.alias("items")).select(
        *RUN_KEY, "category", F.explode("items").alias("e")).select(*RUN_KEY, "category", "e.*")


def evidence_from_diff(scored: DataFrame, diff: DataFrame,
                       dependencies: int | None = DEPENDENCY_EVIDENCE,
                       parameters: int | None = PARAMETER_EVIDENCE) -> DataFrame:
    about = scored.select(*RUN_KEY, "category")
    deps = _top_changes(diff, "dependencies", dependencies).join(
        about.filter(F.col("category").startswith("deps.")), RUN_KEY)
    params = _top_changes(diff, "parameters", parameters).join(about, RUN_KEY)
    return deps.select(*RUN_KEY, "category", _evidence(
        F.col("n") + _DEPENDENCIES, "strong_correlation", _change_text("Dependency"),
        F.concat(F.lit("e-dep"), F.col("key"))).alias("e")).unionByName(
        params.select(*RUN_KEY, "category", _evidence(
            F.col("n") + _PARAMETERS, "inference", _change_text("Parameter"),
            F.concat(F.lit("e-param"), F.col("key"))).alias("e"))
    ).select(*RUN_KEY, "category", "e.*")


def evidence_from_issues(scored: DataFrame, ranked: DataFrame, issues: DataFrame) -> DataFrame:
    """A line per ranked issue (``Investigation.ranked_issues``); ties keep the issue order."""
    platform = "platform" if "platform" in issues.columns else "cast(null as string)"
    top = ranked.join(shuffled(
        issues.select(F.col("key").alias("issue_key"), "title", "url", F.expr(platform).alias("issue_platform"))), "issue_key")
    percent = F.floor(F.col("similarity") * 100).cast("string")
    return top.join(shuffled(scored.select(*RUN_KEY, "category")), RUN_KEY).select(
        *RUN_KEY, "category", _evidence(
            F.col("n") + _ISSUES, "inference",
            F.concat(F.lit("Similar prior incident "), F.col("issue_key"), F.lit(': "'),
                     F.col("title"), F.lit('" (similarity '), percent, F.lit("%).")),
            F.concat(F.lit("e-issue"), F.col("issue_key")), url=F.col("url"),
            ref=source_ref(F.col("issue_platform"), F.col("issue_key"), F.col("url"))).alias("e")
    ).select(*RUN_KEY, "category", "e.*")


def evidence_alternates(scored: DataFrame, alternates: int | None = ALTERNATES) -> DataFrame:
    return scored.select(*RUN_KEY, F.explode(F.expr(_seconds(alternates))).alias("c")).select(
        *RUN_KEY, F.col("c.category").alias("category"), _evidence(
            F.lit(0), "inference",
            F.concat(F.col("c.matches").cast("string"),
                     F.lit(" signature match(es) contributed to this category.")),
            F.concat(F.lit("e-alt"), F.col("c.category"))).alias("e")
    ).select(*RUN_KEY, "category", "e.*")


def build_evidence(scored: DataFrame, diff: DataFrame, ranked: DataFrame | None,
                   issues: DataFrame | None, dependencies: int | None = DEPENDENCY_EVIDENCE,
                   parameters: int | None = PARAMETER_EVIDENCE,
                   alternates: int | None = ALTERNATES) -> DataFrame:
    """All evidence, one row each, ordered by ``ord`` within a hypothesis."""
    parts = [evidence_from_run(scored), evidence_from_diff(scored, diff, dependencies, parameters),
             evidence_alternates(scored, alternates)]
    if ranked is not None and issues is not None:
        parts.append(evidence_from_issues(scored, ranked, issues))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("evidence_id", short_id("seed")).drop("seed")


# --- incidents --------------------------------------------------------------

def notes(scored: DataFrame) -> Column:
    collapsed = F.col("removed_duplicates") + F.col("removed_cascades")
    return F.array_compact(F.array(
        F.when(F.col("hit_count") > 0, F.concat(
            F.lit("Redacted "), F.col("hit_count").cast("string"),
            F.lit(" sensitive value(s) before analysis."))),
        F.when(collapsed > 0, F.concat(
            F.lit("Collapsed "), F.col("removed_duplicates").cast("string"),
            F.lit(" duplicate and "), F.col("removed_cascades").cast("string"),
            F.lit(" cascading error line(s)."))),
        F.when(~F.col("compared"), F.lit(
            "No baseline run provided; add one with --baseline for stronger correlation.")),
    ))


def build_incidents(scored: DataFrame, created_at: str | None = None) -> DataFrame:
    """One incident per run, headed by its best hypothesis.

    ``created_at`` stamps the rows; the clock is not read. ``incident_id`` comes from
    the run's id, so equal ids of two platforms share it; ``incident_key`` does not.
    """
    # exploded, so that a filter on what comes of it stays above and does not work it out again
    headed = scored.withColumn("head", ranked_hypotheses()[0]).withColumn("top", F.explode(F.array("head")))
    cause = F.when(F.col("earliest_message").isNotNull(), F.concat(
        F.lit(" The earliest meaningful error was: "), F.col("earliest_message")))
    return headed.select(
        "run_id",
        short_id("concat('inc', run_id)").alias("incident_id"),
        F.concat_ws(":", "platform", "run_id").alias("incident_key"),
        F.concat(F.col("pipeline"), F.lit(": "), F.col("top.title")).alias("title"),
        "platform", "pipeline",
        F.coalesce("failed_stage", "earliest_source").alias("failed_stage"),
        F.col("top.category").alias("category"),
        F.col("top.confidence").alias("confidence"),
        F.col("top.score").alias("score"),
        F.concat(F.col("pipeline"), F.lit(" failed with probable cause: "), F.col("top.title"),
                 F.lit("."), F.coalesce(cause, F.lit(""))).alias("summary"),
        F.when(F.col("meaningful") > 0, "completed").otherwise("insufficient_evidence")
        .alias("status"),
        notes(scored).alias("notes"),
        "meaningful", "related_issues", "reason", "token", "predates",
        F.lit(created_at).cast("string").alias("created_at"),
    )


def fail_gate(incidents: DataFrame, threshold: str) -> DataFrame:
    """Runs whose confidence reaches ``threshold``."""
    return incidents.filter(
        scoring.confidence_rank(F.col("confidence")) >= fixed.CONFIDENCE_RANK[threshold])
