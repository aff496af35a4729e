"""Platform payloads -> runs, log events, configs and changes.

Every normaliser is a projection over a table of payloads (nested arrays are
exploded inside their row); no payload is grouped or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from . import schemas
from .logs import parse_lines, text_lines
from .model import run_key, CHANGE_COLUMNS, EVENT_COLUMNS, event_struct, events_from_array, run_row, source_ref


def _first(array: Column, field: str) -> Column:
    return F.try_element_at(array, F.lit(1))[field]


# --- dbt --------------------------------------------------------------------

def dbt_scan(spark: SparkSession, run_results: str | list[str],
             manifest: str | list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    results = spark.read.schema(schemas.DBT_RUN_RESULTS).option("multiLine", True).json(run_results)
    nodes = None
    if manifest is not None:
        nodes = spark.read.schema(schemas.DBT_MANIFEST).option("multiLine", True).json(
            manifest).select(F.explode("nodes").alias("unique_id", "node")).select(
            "unique_id", F.coalesce("node.original_file_path", "node.path").alias("code_path"))
    return results, nodes


_DBT_FAILED = ["error", "fail", "runtime error"]


def dbt_runs(run_results: DataFrame, pipeline: str = "dbt project") -> DataFrame:
    failing = F.filter("results", lambda r: r["status"].isin(_DBT_FAILED))
    run_id = F.coalesce("metadata.invocation_id", F.lit("dbt-run"))
    return run_results.select(*run_row(
        run_id, F.lit("dbt"), F.lit(pipeline),
        F.when(F.size(failing) > 0, "failed").otherwise("success"),
        source_ref(F.lit("dbt"), run_id),
        failed_stage=_first(failing, "unique_id"), started_at=F.col("metadata.generated_at")))


def dbt_events(run_results: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One event per result; the code path comes from the manifest's nodes."""
    rows = run_results.select(
        F.coalesce("metadata.invocation_id", F.lit("dbt-run")).alias("run_id"),
        F.posexplode("results").alias("pos", "r")).select("run_id", "pos", "r.*")
    if nodes is None:
        rows = rows.withColumn("code_path", F.lit(None).cast("string"))
    else:
        rows = rows.join(nodes, "unique_id", "left")
    severity = (F.when(F.col("status").isin(_DBT_FAILED), "error")
                .when(F.col("status") == "warn", "warning").otherwise("info"))
    message = F.concat(
        F.lit("["), F.col("status"), F.lit("] "), F.col("unique_id"),
        F.when(F.coalesce("message", F.lit("")) != "", F.concat(F.lit(": "), F.col("message")))
        .otherwise(""),
        F.when(F.coalesce("failures", F.lit(0)) != 0,
               F.concat(F.lit(" ("), F.col("failures").cast("string"), F.lit(" failing rows)")))
        .otherwise(""))
    return rows.select(
        "run_id", F.lit("dbt").alias("platform"), F.col("pos").cast("bigint").alias("seq"),
        F.lit(None).cast("string").alias("timestamp"), severity.alias("severity"),
        message.alias("message"), F.col("unique_id").alias("source"),
        F.when(F.col("code_path").isNotNull(), F.struct(
            F.col("code_path").alias("path"), F.lit(None).cast("bigint").alias("line"),
            F.lit(None).cast("string").alias("symbol"))).alias("code"),
        F.lit(False).alias("redacted"))


# --- CI runs ----------------------------------------------------------------

def gha_failed_steps(jobs: DataFrame) -> DataFrame:
    """First failing ``job / step`` per run, in job then step order.

    ``jobs`` has one row per job with its position ``job_ord`` in the run.
    """
    steps = jobs.select("run_id", "job_ord", F.col("name").alias("job"),
                        F.posexplode("steps").alias("step_ord", "step"))
    return steps.filter(F.col("step.conclusion") == "failure").groupBy("run_id").agg(
        F.min_by(F.concat("job", F.lit(" / "), "step.name"), F.struct("job_ord", "step_ord"))
        .alias("failed_stage"))


def gha_runs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    stages = gha_failed_steps(jobs).withColumnRenamed("run_id", "id")
    platform = F.lit("github-actions")
    return runs.join(stages, "id", "left").select(*run_row(
        F.col("id"), platform, F.col("name"), ci_status(F.col("conclusion")),
        source_ref(platform, F.col("id").cast("string"), F.col("html_url"),
                   branch=F.col("head_branch"), sha=F.col("head_sha"), workflow=F.col("path")),
        failed_stage=F.col("failed_stage"), started_at=F.col("run_started_at"),
        finished_at=F.col("updated_at")))


def ci_status(conclusion: Column) -> Column:
    return (F.when(conclusion == "success", "success").when(conclusion == "failure", "failed")
            .otherwise("unknown"))


def gha_events(logs: DataFrame, frames: bool = True) -> DataFrame:
    lines = text_lines(logs, F.col("text"), "run_id").select(
        F.col("run_id").cast("string").alias("run_id"), F.lit("github-actions").alias("platform"),
        "seq", "line", F.lit(None).cast("string").alias("source"))
    return parse_lines(lines, frames)


def gha_changes(commits: DataFrame) -> DataFrame:
    """``commits`` carries the list position as ``ord``."""
    message = F.col("commit.message")
    return commits.select(
        "ord", F.col("sha").alias("id"), F.lit("github").alias("platform"),
        F.lit("commit").alias("kind"), F.split(message, "\n")[0].alias("title"),
        F.col("commit.author.date").alias("timestamp"),
        F.col("commit.author.name").alias("author"), message.alias("summary"),
        source_ref(F.lit("github"), F.col("sha"), F.col("html_url")).alias("source_ref"))


# --- cluster jobs -----------------------------------------------------------

def _failed_tasks() -> Column:
    return F.filter("tasks", lambda t: t["state"] == "FAILED")


def databricks_runs(jobs: DataFrame) -> DataFrame:
    platform = F.lit("databricks")
    return jobs.select(*run_row(
        F.col("run_id"), platform, F.col("job_name"),
        F.when(F.col("result_state") == "SUCCESS", "success").otherwise("failed"),
        source_ref(platform, F.col("run_id").cast("string"), job=F.col("job_name")),
        failed_stage=_first(_failed_tasks(), "key"), started_at=F.col("start_time")))


def databricks_events(jobs: DataFrame) -> DataFrame:
    """Driver stderr; where it has no line, the first failed task's error.

    The stage is the failed task's key.
    """
    task = F.try_element_at(_failed_tasks(), F.lit(1))
    rows = jobs.select(
        F.col("run_id").cast("string").alias("run_id"), F.lit("databricks").alias("platform"),
        task["key"].alias("source"), task["error"].alias("error"),
        parsing.split_lines(F.coalesce("driver_stderr", F.lit(""))).alias("lines"))
    logged = rows.select(
        "run_id", "platform", "source", F.posexplode("lines").alias("pos", "line")).select(
        "run_id", "platform", F.col("pos").cast("bigint").alias("seq"), "line", "source")
    bare = events_from_array(
        rows.filter((F.size("lines") == 0) & (F.coalesce("error", F.lit("")) != "")),
        F.col("run_id"), F.col("platform"),
        F.array(event_struct("error", F.col("error"), F.col("source"))))
    return parse_lines(logged).unionByName(bare.select(*EVENT_COLUMNS))


def databricks_configs(jobs: DataFrame) -> DataFrame:
    snapshots = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("libraries").alias("kind"),
                 F.col("libraries").alias("values")),
        F.struct(F.lit(1).alias("ord"), F.lit("runtime").alias("kind"),
                 F.create_map(F.lit("spark_version"), F.col("cluster.spark_version"),
                              F.lit("node_type"), F.col("cluster.node_type")).alias("values")))
    return jobs.select(F.lit("databricks").alias("platform"), F.col("run_id").cast("string").alias("run_id"),
                       F.explode(snapshots).alias("c")).select("platform", "run_id", "c.*").filter(
        F.col("values").isNotNull())


# --- warehouse queries ------------------------------------------------------

def snowflake_runs(queries: DataFrame) -> DataFrame:
    platform = F.lit("snowflake")
    return queries.select(*run_row(
        F.col("query_id"), platform, F.lit("Snowflake query"),
        F.when(F.col("execution_status") == "SUCCESS", "success").otherwise("failed"),
        source_ref(platform, F.col("query_id"), warehouse=F.col("warehouse_name")),
        started_at=F.col("start_time"), duration_ms=F.col("total_elapsed_time_ms")))


def snowflake_events(queries: DataFrame) -> DataFrame:
    info = F.concat(F.lit("Query "), F.col("query_id"), F.lit(" on "), F.col("warehouse_name"),
                    F.lit(" ("), F.col("total_elapsed_time_ms").cast("string"), F.lit(" ms)"))
    failed = (F.col("execution_status") == "FAIL") & (
        F.coalesce("error_message", F.lit("")) != "")
    return events_from_array(queries, F.col("query_id"), F.lit("snowflake"), F.array(
        event_struct("info", info, timestamp=F.col("start_time")),
        F.when(failed, event_struct(
            "error", F.concat("error_code", F.lit(": "), "error_message"),
            F.col("query_id"), F.col("start_time")))))


def snowflake_configs(queries: DataFrame) -> DataFrame:
    return queries.select(
        F.lit("snowflake").alias("platform"), F.col("query_id").alias("run_id"), F.lit(0).alias("ord"), F.lit("query").alias("kind"),
        F.create_map(F.lit("text"), F.col("query_text"),
                     F.lit("warehouse"), F.col("warehouse_name")).alias("values"))


def snowflake_changes(ddl: DataFrame) -> DataFrame:
    """DDL history (with its position ``ord``) -> schema changes."""
    return ddl.select(
        "ord", "id", F.lit("snowflake").alias("platform"), F.lit("schema_change").alias("kind"),
        F.col("statement").alias("title"), F.col("executed_at").alias("timestamp"),
        F.lit(None).cast("string").alias("author"), "summary",
        source_ref(F.lit("snowflake"), F.col("object")).alias("source_ref"))


# --- document-store operations ----------------------------------------------

def _store_error() -> Column:
    """The logged error, else a synthetic one for an unindexed scan."""
    unindexed = F.col("plan_summary").contains("COLLSCAN") & (
        F.col("docs_examined") > 10 * F.greatest(F.lit(1), F.col("docs_returned")))
    return F.when(F.coalesce("error", F.lit("")) != "", F.col("error")).when(
        unindexed, F.concat(
            F.lit("COLLSCAN: no index available; examined "),
            F.col("docs_examined").cast("string"), F.lit(" docs to return "),
            F.col("docs_returned").cast("string")))


def mongo_runs(ops: DataFrame) -> DataFrame:
    platform = F.lit("mongodb")
    return ops.select(*run_row(
        F.col("operation_id"), platform,
        F.concat("db", F.lit("."), "collection", F.lit(" "), "op"),
        F.when(_store_error().isNotNull(), "failed").otherwise("success"),
        source_ref(platform, F.col("operation_id"), db=F.col("db"),
                   collection=F.col("collection")),
        duration_ms=F.col("duration_ms")))


def mongo_events(ops: DataFrame) -> DataFrame:
    place = F.concat("db", F.lit("."), "collection")
    info = F.concat(
        F.col("op"), F.lit(" on "), place, F.lit(" — plan "), F.col("plan_summary"), F.lit(", "),
        F.col("duration_ms").cast("string"), F.lit(" ms, examined "),
        F.col("docs_examined").cast("string"), F.lit(" / returned "),
        F.col("docs_returned").cast("string"))
    error = _store_error()
    return events_from_array(ops, F.col("operation_id"), F.lit("mongodb"), F.array(
        event_struct("info", info),
        F.when(error.isNotNull(), event_struct("error", error, place))))


# --- issues -----------------------------------------------------------------

def issues_normalize(records: DataFrame) -> DataFrame:
    """Issue records (with their position ``ord``) -> external issues."""
    return records.select(
        "ord", F.col("key").alias("id"), F.lit("jira").alias("platform"), "key", "title",
        "status", "url", "labels")


def issue_search(issues: DataFrame, status: str | None = None,
                 title_contains: str | None = None) -> DataFrame:
    if status is not None:
        issues = issues.filter(F.col("status") == status)
    if title_contains is not None:
        issues = issues.filter(F.lower("title").contains(title_contains.lower()))
    return issues


# --- over any source --------------------------------------------------------

def runs_list(runs: DataFrame, status: str = "all", pipeline: str | None = None,
              limit: int | None = None) -> DataFrame:
    """Runs by status (``failed``, ``success`` or ``all``) and pipeline; with
    ``limit``, the latest ones by start."""
    if status in ("failed", "success"):
        runs = runs.filter(F.col("status") == status)
    if pipeline is not None:
        runs = runs.filter(F.col("pipeline") == pipeline)
    if limit is not None:
        runs = runs.orderBy(F.desc("started_at"), "run_id").limit(limit)
    return runs


def run_get(runs: DataFrame, run_id: str, platform: str | None = None) -> DataFrame:
    """The run of that id; on several platforms, of the one named."""
    found = runs.filter(F.col("run_id") == run_id)
    return found if platform is None else found.filter(F.col("platform") == platform)


def runs_get(runs: DataFrame, ids: DataFrame) -> DataFrame:
    own = run_key(ids)
    return runs.join(ids.select(*own).distinct(), own, "left_semi")


def missing_runs(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids that no source knows."""
    own = run_key(ids)
    return ids.select(*own).distinct().join(runs.select(*own), own, "left_anti")


def changes_union(*sources: DataFrame) -> DataFrame:
    """Change events of all sources in registry order, each (platform, id) once.

    The order is (source, position); it is a struct, so no global numbering and
    no sort of the whole table is needed.
    """
    out = None
    for i, source in enumerate(sources):
        part = source.select(*CHANGE_COLUMNS).withColumn(
            "ord", F.struct(F.lit(i).alias("source"), F.col("ord").cast("bigint").alias("pos")))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy("platform", "id").agg(F.min_by(F.struct(*CHANGE_COLUMNS), "ord").alias("c"))
    return first.select("c.*")
