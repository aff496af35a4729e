"""Report datasets: SARIF findings and rules, diff rows, error stream, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dedup
from ..operators.compare import SECTION_ORDER
from ..sources.model import RUN_KEY, run_key
from .investigate import Investigation

NEW_ERROR_ROWS = 10


def sarif_findings(hypotheses: DataFrame) -> DataFrame:
    level = (F.when(F.col("confidence") == "high", "error")
             .when(F.col("confidence") == "medium", "warning").otherwise("note"))
    return hypotheses.select(
        *run_key(hypotheses), "rank", F.col("category").alias("rule_id"), level.alias("level"),
        F.concat("title", F.lit(" — "), "rationale").alias("text"),
        F.col("code.path").alias("uri"),
        F.when(F.col("code.line") != 0, F.col("code.line")).alias("start_line"))


def sarif_rules(hypotheses: DataFrame) -> DataFrame:
    """Distinct rules per report; the last title of a category names it."""
    return hypotheses.groupBy(*run_key(hypotheses), F.col("category").alias("rule_id")).agg(
        F.max_by("title", "rank").alias("name"))


def diff_report_rows(diff: DataFrame, new_errors: DataFrame,
                     limit: int | None = NEW_ERROR_ROWS) -> DataFrame:
    """Diff sections in report order, then the first new errors of each run, ``limit`` of them or all.

    Rows sort by (run_id, section_ord, sort_key, key)."""
    order = F.create_map(*[F.lit(x) for kv in SECTION_ORDER.items() for x in kv])
    own = run_key(diff)
    rows = diff.select(
        *own, order[F.col("section")].alias("section_ord"), "section",
        F.lower("key").alias("sort_key"), "key", "before", "after")
    first = Window.partitionBy(*own).orderBy("seq")
    errors = new_errors.withColumn("n", F.row_number().over(first))
    errors = (
        (errors if limit is None else errors.filter(F.col("n") <= limit))
        .select(*own, F.lit(len(SECTION_ORDER) + 1).alias("section_ord"),
                F.lit("new_errors").alias("section"),
                F.lpad(F.col("n").cast("string"), 2 if limit is not None and limit < 100 else 18, "0").alias("sort_key"),
                F.col("message").alias("key"), F.lit(None).cast("string").alias("before"),
                F.lit(None).cast("string").alias("after")))
    return rows.unionByName(errors)


def evidence_stream(meaningful: DataFrame) -> DataFrame:
    return meaningful.select(
        *run_key(meaningful), "seq",
        F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("] "), F.col("message"))
        .alias("line"))


def incident_documents(inv: Investigation) -> DataFrame:
    """One nested row per run: the incident with its hypotheses, each with its
    evidence and recommendations.

    All nested lists have fixed upper bounds (three hypotheses, at most five
    plus five plus three plus three evidence rows, four recommendations), so
    grouping them per run is safe. Unbounded lists (error stream, diff, related issues, changes) are
    separate datasets with the same key: see ``result_datasets``.
    """
    evidence = inv.evidence().groupBy(*RUN_KEY, "category").agg(F.expr(
        # maps (in source_ref) can't be sorted by, so the position alone decides
        """transform(array_sort(collect_list(struct(ord, evidence_id, kind, statement, log_seq, url, code, source_ref)),
           (a, b) -> case when a.ord < b.ord then -1 when a.ord > b.ord then 1 else 0 end), x -> x)""").alias("evidence"))
    steps = inv.recommendations().groupBy(*RUN_KEY, "category").agg(F.sort_array(F.collect_list(
        F.struct("ord", "recommendation_id", "kind", "description", "mutates")))
        .alias("recommendations"))
    hypotheses = (
        inv.hypotheses().join(evidence, [*RUN_KEY, "category"], "left")
        .join(steps, [*RUN_KEY, "category"], "left")
        .groupBy(*RUN_KEY).agg(F.expr("""array_sort(collect_list(struct(
            rank, hypothesis_id, category, title, rationale, confidence, score, code, evidence, recommendations)),
            (a, b) -> a.rank - b.rank)""").alias("hypotheses"))
    )
    return inv.incidents().join(hypotheses, RUN_KEY)


def result_datasets(inv: Investigation) -> dict[str, DataFrame]:
    """The whole result of an investigation: the incident documents and, keyed by run, what has no bound per run."""
    out = {"incidents": incident_documents(inv), "diff": inv.diff}
    if inv.errors is not None:
        out["errors"] = evidence_stream(dedup.dedup_errors(inv.errors))
    if inv.closest is not None:
        out["related_issues"] = inv.ranked_issues(None)
    if inv.changes is not None:
        out["changes"] = inv.scored.filter("change_id is not null").select(
            *RUN_KEY, "token", "change_id", "change_kind", "change_title", "predates", "change_ref")
    return out


def incidents_json_sink(inv: Investigation, path: str) -> None:
    """The incident documents alone, as one JSON dataset."""
    incident_documents(inv.staged()).write.mode("errorifexists").json(path)


def result_json_sink(inv: Investigation, path: str) -> dict[str, str]:
    """Every dataset of the result as JSON below ``path``; the folders written."""
    folders = {}
    for name, rows in result_datasets(inv.staged()).items():
        folders[name] = f"{path}/{name}"
        rows.write.mode("errorifexists").json(folders[name])
    return folders
