"""One query per operator: (spark, sf_dir) -> flat DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, injection, parsing, redaction, scoring, templates, text
from ..functions.signatures import category_label
from ..operators import classify, compare, correlate, dedup, frames, trend
from ..operators.skew import shuffled
from ..plans import investigate as inv
from ..plans import reports
from ..sources import logs
from ..sources import platforms as P
from ..sources import registry
from ..sources.model import RUN_KEY
from ..storage import materialize, new_path
from ..streaming import watch
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs ----------------------------------------------------------

def events(spark, d, with_frames=False) -> DataFrame:
    """Parsed and redacted log events."""
    return redaction.redact_log_events(logs.parse_lines(A.log_lines(spark, d), with_frames))


def groups(spark, d, with_frames=False) -> DataFrame:
    return dedup.template_groups(events(spark, d, with_frames), counters=True)


def triage(spark, d, with_frames=False) -> DataFrame:
    return classify.triage_runs(groups(spark, d, with_frames))


def changes(spark, d) -> DataFrame:
    return P.changes_union(P.snowflake_changes(A.ddl_history(spark, d)))


def issues(spark, d) -> DataFrame:
    return P.issues_normalize(A.issue_records(spark, d))


def investigation(spark, d, **options) -> inv.Investigation:
    options = {"changes": changes(spark, d), "issues": issues(spark, d)} | options
    # runs, configurations and lines have several consumers (frames are found apart): written once,
    # or they are made of the events for each
    lines = materialize(A.log_lines(spark, d).drop("ts"), "log_lines")
    return inv.investigate(
        materialize(A.runs(spark, d), "runs"), logs.parse_lines(lines),
        configs=materialize(A.configs(spark, d), "configs"), **options)


def offline(spark, d) -> inv.Investigation:
    """Without changes and issues."""
    return investigation(spark, d, changes=None, issues=None)


def diff(spark, d) -> DataFrame:
    runs = A.runs(spark, d)
    return compare.diff_records(
        compare.run_entries(runs, A.configs(spark, d)), compare.baseline_link(runs))


def section(spark, d, name) -> DataFrame:
    return diff(spark, d).filter(F.col("section") == name).select(
        "run_id", "key", "before", "after")


def new_errors(spark, d) -> DataFrame:
    return compare.new_errors(events(spark, d), compare.baseline_link(A.runs(spark, d))).drop("platform")


# --- sources ----------------------------------------------------------------

@query
def log_lines_scan(spark, d):
    return logs.text_lines(A.table(spark, d, "documents"), F.col("text"), "doc_id")


@query
def log_files_scan(spark, d):
    """Log files on disk, numbered; a blank file is a run without lines."""
    path = new_path(spark, "logs")
    return logs.scan_folders(spark, A.write_log_files(spark, d, path)).select(
        F.regexp_extract("path", "run=([^/]+)/", 1).alias("run_id"), "seq", "line")


def _meta_runs(spark, d):
    return logs.run_meta_join(A.log_files(spark, d), A.sidecars(spark, d))


@query
def run_meta_join(spark, d):
    return _meta_runs(spark, d).select(
        "run_id", "platform", "pipeline", "failed_stage", "status", "baseline_id",
        F.col("parameters")["rows"].alias("rows"))


@query
def meta_config_explode(spark, d):
    return logs.meta_config_explode(_meta_runs(spark, d)).select(
        "run_id", "kind", F.explode("values").alias("key", "value"))


@query
def baseline_link(spark, d):
    return compare.baseline_link(A.runs(spark, d)).drop("platform")


_FLAT_EVENT = ["run_id", "platform", "seq", "severity", "message", "source"]


@query
def dbt_normalize(spark, d):
    return P.dbt_events(A.dbt_results(spark, d), A.dbt_nodes(spark, d)).select(
        *_FLAT_EVENT, F.col("code.path").alias("code_path"))


def _dbt_scanned(spark, d):
    return P.dbt_scan(spark, *A.write_dbt_files(spark, d, new_path(spark, "dbt")))


@query
def dbt_scan_events(spark, d):
    """Artifacts and manifests read from files; the manifests' nodes give the code paths."""
    return P.dbt_events(*_dbt_scanned(spark, d)).select(*_FLAT_EVENT, F.col("code.path").alias("code_path"))


@query
def dbt_scan(spark, d):
    results, _ = _dbt_scanned(spark, d)
    return P.dbt_runs(results).select(
        "run_id", "platform", "pipeline", "failed_stage", "status", "started_at")


@query
def gha_normalize(spark, d):
    return P.gha_runs(A.ci_runs(spark, d), A.ci_jobs(spark, d)).select(
        "run_id", "platform", "pipeline", "failed_stage", "status", "started_at",
        F.col("source_ref.url").alias("url"),
        F.col("source_ref.locator")["branch"].alias("branch"),
        F.col("source_ref.locator")["sha"].alias("sha"))


@query
def gha_log_events(spark, d):
    return P.gha_events(A.ci_logs(spark, d), frames=False).select(
        "run_id", "seq", "severity", "message", "timestamp")


_FLAT_CHANGE = ["platform", "id", "kind", "title", "summary", "timestamp", "author"]


@query
def gha_changes(spark, d):
    return P.gha_changes(A.commits(spark, d)).select(*_FLAT_CHANGE)


@query
def databricks_normalize(spark, d):
    return P.databricks_events(A.job_runs(spark, d)).select(*_FLAT_EVENT)


@query
def databricks_runs(spark, d):
    jobs = A.job_runs(spark, d)
    settings = P.databricks_configs(jobs).select(
        "run_id", F.explode("values").alias("key", "value"))
    return P.databricks_runs(jobs).select(
        "run_id", "pipeline", "failed_stage", "status", "started_at").join(settings, "run_id")


@query
def snowflake_normalize(spark, d):
    return P.snowflake_events(A.warehouse_queries(spark, d)).select(*_FLAT_EVENT, "timestamp")


@query
def snowflake_runs(spark, d):
    return P.snowflake_runs(A.warehouse_queries(spark, d)).select(
        "run_id", "platform", "pipeline", "status", "started_at", "duration_ms",
        F.col("source_ref.locator")["warehouse"].alias("warehouse"))


@query
def snowflake_configs(spark, d):
    return P.snowflake_configs(A.warehouse_queries(spark, d)).select(
        "run_id", "kind", F.explode("values").alias("key", "value"))


@query
def snowflake_changes(spark, d):
    return P.snowflake_changes(A.ddl_history(spark, d)).select(*_FLAT_CHANGE)


@query
def mongo_normalize(spark, d):
    return P.mongo_events(A.store_operations(spark, d)).select(*_FLAT_EVENT)


@query
def mongo_runs(spark, d):
    return P.mongo_runs(A.store_operations(spark, d)).select(
        "run_id", "pipeline", "status", "duration_ms")


@query
def issues_normalize(spark, d):
    return issues(spark, d).select("id", "platform", "key", "title", "status", "url")


@query
def runs_list(spark, d):
    runs = P.gha_runs(A.ci_runs(spark, d), A.ci_jobs(spark, d))
    return P.runs_list(runs, status="failed").select("run_id", "status", "failed_stage")


@query
def run_get(spark, d):
    """Runs whose id appears among the users with a purchase in the first week."""
    ids = A.with_keys(A.table(spark, d, "events")).filter("event_type = 'purchase' and wk = 0") \
        .select(F.expr(A.RUN_ID).alias("run_id"))
    return P.runs_get(A.runs(spark, d), ids).select("run_id", "platform", "pipeline")


@query
def missing_runs(spark, d):
    ids = A.table(spark, d, "customer").select(
        F.concat(F.col("c_custkey").cast("string"), F.lit("-w0")).alias("run_id"))
    return P.missing_runs(A.runs(spark, d), ids)


@query
def changes_union(spark, d):
    commits = P.gha_changes(A.commits(spark, d))
    ddl = P.snowflake_changes(A.ddl_history(spark, d))
    return P.changes_union(commits, ddl, commits).select(
        F.col("ord.source").cast("bigint").alias("source"), F.col("ord.pos").alias("pos"),
        "platform", "id", "kind", "title")


@query
def incidents_json_sink(spark, d):
    """Write the incidents as JSON, read them back."""
    path = new_path(spark, "incidents")
    result = offline(spark, d)
    reports.incidents_json_sink(result, path)
    return spark.read.schema(
        "run_id string, title string, category string, confidence string, score double, "
        "hypotheses array<struct<category:string,evidence:array<struct<kind:string>>,"
        "recommendations:array<struct<kind:string>>>>"
    ).json(path).select(
        "run_id", "title", "category", "confidence", "score",
        F.size("hypotheses").cast("bigint").alias("n_hypotheses"),
        F.aggregate("hypotheses", F.lit(0).cast("bigint"),
                    lambda a, h: a + F.size(h["evidence"])).alias("n_evidence"),
        F.aggregate("hypotheses", F.lit(0).cast("bigint"),
                    lambda a, h: a + F.size(h["recommendations"])).alias("n_recommendations"))


@query
def result_json_sink(spark, d):
    """The whole result, correlation on, as JSON datasets; read back, rows by dataset and run."""
    folders = reports.result_json_sink(investigation(spark, d), new_path(spark, "result"))
    out = None
    for name, folder in sorted(folders.items()):
        rows = spark.read.schema("run_id string").json(folder).groupBy("run_id").agg(F.count("*").alias("n")).select(
            F.lit(name).alias("dataset"), "run_id", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def sarif_findings(spark, d):
    return reports.sarif_findings(investigation(spark, d).hypotheses()).drop("platform")


@query
def sarif_rules(spark, d):
    return reports.sarif_rules(investigation(spark, d).hypotheses()).drop("platform")


@query
def diff_report_rows(spark, d):
    """The report's rows: at most ten new errors a run."""
    return reports.diff_report_rows(diff(spark, d).drop("platform"), new_errors(spark, d))


@query
def evidence_stream(spark, d):
    return reports.evidence_stream(dedup.dedup_errors(events(spark, d))).drop("platform")


# --- lines ------------------------------------------------------------------

@query
def parse_severity(spark, d):
    return A.log_lines(spark, d).select(
        "run_id", "seq", parsing.parse_severity(F.col("line")).alias("severity"))


@query
def parse_timestamp(spark, d):
    return A.log_lines(spark, d).select(
        "run_id", "seq", parsing.parse_timestamp(F.col("line")).alias("timestamp"))


@query
def parse_code_ref(spark, d):
    return A.log_lines(spark, d).withColumn("c", parsing.parse_code_ref(F.col("line"))).filter(
        "c is not null").select("run_id", "seq", "c.*")


@query
def attach_frame(spark, d):
    out = frames.attach_frame(logs.parse_lines(A.log_lines(spark, d), False).drop("code"),
                              block_rows=5_000)
    return out.select("run_id", "seq", "severity", F.col("code.path").alias("path"),
                      F.col("code.line").alias("line"), F.col("code.symbol").alias("symbol"))


# --- redaction --------------------------------------------------------------

_RULE_QUERIES = {
    "redact_connection_string": "connection_string",
    "redact_aws_key": "aws_access_key_id",
    "redact_aws_secret": "aws_secret",
    "redact_github_token": "github_token",
    "redact_slack_token": "slack_token",
    "redact_jwt": "jwt",
    "redact_private_key": "private_key",
    "redact_auth_header": "authorization_header",
    "redact_secret_kv": "generic_secret_kv",
    "redact_email": "email",
}


def _rule_query(rule):
    def run(spark, d):
        """One rule alone over the whole documents."""
        return redaction.redact_text(A.secret_text(spark, d), "text", hits=None, only=rule) \
            .withColumn("n_hits", F.col("n_hits").cast("bigint"))
    return run


for _name, _rule in _RULE_QUERIES.items():
    QUERIES[_name] = _rule_query(_rule)


def _level_query(level):
    def run(spark, d):
        out = redaction.redact_text(A.secret_text(spark, d), "text", level)
        return out.select("doc_id", "text", F.array_join("hits", ",").alias("hits"),
                          F.col("n_hits").cast("bigint").alias("n_hits"))
    return run


QUERIES["redact_text"] = _level_query("strict")
QUERIES["redact_text_standard"] = _level_query("standard")


@query
def redact_log_events(spark, d):
    return events(spark, d).select(
        "run_id", "seq", "message", "redacted", F.col("n_hits").cast("bigint").alias("n_hits"))


@query
def redaction_counts(spark, d):
    return redaction.redaction_counts(events(spark, d))


@query
def mask_fields(spark, d):
    values = F.create_map(
        F.lit("Password"), F.col("lang"), F.lit("region"), F.col("source"),
        F.lit("note"), F.col("secret"))
    texts = A.table(spark, d, "documents").withColumn("secret", F.expr(A.SECRET_TEXT))
    return texts.select("doc_id", values.alias("vals")).select(
        "doc_id", F.explode(redaction.mask_fields("vals", ["PASSWORD"])).alias("key", "value"))


@query
def injection_scan(spark, d):
    found = injection.injection_markers(F.col("text"))
    return A.untrusted_text(spark, d).withColumn("m", found).select(
        "conv_id", "turn", (F.size("m") > 0).alias("suspicious"),
        F.array_join("m", "|").alias("markers"))


@query
def untrusted_neutralize(spark, d):
    safe = A.untrusted_text(spark, d).withColumn("text", injection.neutralize(F.col("text")))
    return safe.withColumn("m", injection.injection_markers(F.col("text"))).select(
        "conv_id", "turn", "text", (F.size("m") > 0).alias("suspicious"))


# --- deduplication ----------------------------------------------------------

def _error_events(spark, d):
    return events(spark, d).filter(parsing.is_error(F.col("severity")))


@query
def normalize_template(spark, d):
    return _error_events(spark, d).select(
        "run_id", "seq", templates.normalize_template(F.col("message")).alias("template"))


@query
def is_cascade(spark, d):
    return _error_events(spark, d).select(
        "run_id", "seq", templates.is_cascade(F.col("message")).alias("cascade"))


@query
def dedup_errors(spark, d):
    return dedup.dedup_errors(events(spark, d)).select(
        "run_id", "seq", "severity", "message", "template", "n_events")


@query
def dedup_fallback(spark, d):
    """Runs with nothing but cascades, and what they keep."""
    return dedup.dedup_errors(events(spark, d)).filter(~F.col("has_cause")).select(
        "run_id", "seq", "message")


@query
def dedup_counters(spark, d):
    return dedup.dedup_counters(groups(spark, d)).drop("platform")


# --- earliest failure, signatures, classification ---------------------------

@query
def earliest_failure(spark, d):
    return triage(spark, d).filter("earliest_seq is not null").select(
        "run_id", "earliest_seq", "earliest_message", "earliest_source", "reason",
        "match_title", "token")


def _matches(spark, d, with_frames=False):
    return classify.signature_match(dedup.dedup_errors(events(spark, d, with_frames)))


@query
def signature_match(spark, d):
    return _matches(spark, d).select(
        "run_id", "seq", F.col("sig_ord").cast("bigint").alias("sig_ord"), "signature",
        "category", F.col("weight").cast("bigint").alias("weight"))


@query
def signature_match_many(spark, d):
    """1,008 signatures of a user, looked up by their required literals."""
    matches = classify.signature_match(dedup.dedup_errors(events(spark, d)), A.user_signatures())
    return matches.select("run_id", "seq", F.col("sig_ord").cast("bigint").alias("sig_ord"), "signature",
                          "category", F.col("weight").cast("bigint").alias("weight"), "title", "token")


@query
def signature_title(spark, d):
    return _matches(spark, d).select("run_id", "seq", "signature", "title")


@query
def signature_token(spark, d):
    return _matches(spark, d, True).select(
        "run_id", "seq", "signature", "token", F.col("code.path").alias("code_path"),
        F.col("code.line").alias("code_line"))


@query
def classify_by_category(spark, d):
    return classify.classify_by_category(triage(spark, d)).withColumn(
        "rank", F.col("rank").cast("bigint")).drop("platform")


@query
def classify_primary(spark, d):
    return A.runs(spark, d).select(*RUN_KEY).join(triage(spark, d), RUN_KEY, "left").select(
        "run_id", F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("class_score", F.lit(0.0)).alias("score"))


# --- comparison -------------------------------------------------------------

@query
def diff_records(spark, d):
    return diff(spark, d).drop("platform")


for _section, _query in (("parameters", "diff_parameters"), ("dependencies", "diff_dependencies"),
                         ("environment", "diff_environment"), ("configuration", "diff_config")):
    QUERIES[_query] = lambda spark, d, s=_section: section(spark, d, s)

QUERIES["new_errors"] = new_errors


# --- correlation ------------------------------------------------------------

@query
def change_correlate(spark, d):
    tokens = materialize(triage(spark, d).filter("token is not null").select(*RUN_KEY, "token"),
                         "tokens")
    return correlate.change_correlate(
        tokens.join(shuffled(A.runs(spark, d).select(*RUN_KEY, "started_at")), RUN_KEY),
        changes(spark, d)).drop("platform", "change_ref")


@query
def tokenize(spark, d):
    return A.table(spark, d, "documents").select(
        "doc_id", F.explode(text.tokenize(F.col("text"))).alias("token"))


@query
def jaccard_similarity(spark, d):
    """Each conversation turn against the turn before it."""
    turns = A.table(spark, d, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prior"))
    return turns.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        text.jaccard_similarity(F.col("text"), F.col("prior")).alias("similarity"))


@query
def incident_seed(spark, d):
    return correlate.seed_tokens(A.runs(spark, d), events(spark, d)).drop("platform")


@query
def similar_incidents(spark, d):
    return correlate.similar_incidents(
        correlate.seed_tokens(A.runs(spark, d), events(spark, d)), issues(spark, d)).drop("platform")


@query
def related_issues(spark, d):
    """Count and the three most similar issues of each run, without building the pairs."""
    out = correlate.related_issues(
        correlate.seed_tokens(A.runs(spark, d), events(spark, d)), issues(spark, d))
    return out.select("run_id", "n_related", F.explode("top").alias("t")).select(
        "run_id", "n_related", F.col("t.rank").alias("rank"), "t.issue_key", "t.similarity")


@query
def issue_search(spark, d):
    return P.issue_search(issues(spark, d), status="Done", title_contains="Gear").select(
        "key", "title", "status")


# --- hypotheses -------------------------------------------------------------

@query
def score_primary(spark, d):
    return investigation(spark, d).scored.select(
        "run_id", "category", "class_score", F.col("change_id").isNotNull().alias("has_change"),
        "changed_dependencies", "related_issues", "raw_score")


@query
def confidence_bucket(spark, d):
    return classify.classify_by_category(triage(spark, d)).withColumn(
        "raw", scoring.class_score(F.col("weight"))).select(
        "run_id", "category", F.round("raw", 3).alias("score"),
        scoring.confidence_bucket("raw").alias("confidence"))


_FLAT_EVIDENCE = ["run_id", "category", "evidence_id", "kind", "statement"]


def _with_id(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("evidence_id", text.short_id("seed")).select(*_FLAT_EVIDENCE)


@query
def evidence_confirmed(spark, d):
    return _with_id(inv.evidence_from_run(offline(spark, d).scored).filter("kind = 'confirmed'"))


@query
def evidence_change(spark, d):
    scored = investigation(spark, d, issues=None).scored
    return _with_id(inv.evidence_from_run(scored).filter("ord = 1"))


def _diff_evidence(spark, d, kind):
    result = offline(spark, d)
    return _with_id(inv.evidence_from_diff(result.scored, result.diff).filter(
        F.col("kind") == kind))


@query
def evidence_dependency(spark, d):
    return _diff_evidence(spark, d, "strong_correlation")


@query
def evidence_parameter(spark, d):
    return _diff_evidence(spark, d, "inference")


@query
def evidence_no_baseline(spark, d):
    return _with_id(inv.evidence_from_run(offline(spark, d).scored).filter(
        "kind = 'missing_information'"))


@query
def evidence_issue(spark, d):
    result = investigation(spark, d, changes=None)
    return _with_id(inv.evidence_from_issues(result.scored, result.ranked_issues(), result.issues))


@query
def evidence_issue_all(spark, d):
    """Every related issue of every run, ranked."""
    result = investigation(spark, d, changes=None)
    out = inv.evidence_from_issues(result.scored, result.ranked_issues(None), result.issues)
    return out.select("run_id", "statement", "url", F.col("source_ref.platform").alias("ref_platform"),
                      F.col("source_ref.native_id").alias("ref_id"), (F.col("ord") - 4_000_000_000).alias("n"))


@query
def evidence_references(spark, d):
    """What evidence points at: the code of the earliest error, the change that mentions the token."""
    out = inv.evidence_from_run(investigation(spark, d, issues=None).scored)
    return out.filter("code is not null or source_ref is not null").select(
        "run_id", "kind", F.col("code.path").alias("code_path"), F.col("code.line").alias("code_line"),
        F.col("source_ref.platform").alias("ref_platform"), F.col("source_ref.native_id").alias("ref_id"))


@query
def hypotheses_all(spark, d):
    """Every category of a run as a hypothesis, not the first three alone."""
    return investigation(spark, d).hypotheses(alternates=None).select(*_FLAT_HYPOTHESIS)


_FLAT_HYPOTHESIS = ["run_id", "hypothesis_id", "category", "title", "rationale", "confidence",
                    "score"]


@query
def hypothesis_primary(spark, d):
    return investigation(spark, d).hypotheses().filter("is_primary").select(*_FLAT_HYPOTHESIS)


@query
def hypothesis_alternates(spark, d):
    return offline(spark, d).hypotheses().filter("not is_primary").select(*_FLAT_HYPOTHESIS)


@query
def hypothesis_rank(spark, d):
    return investigation(spark, d).hypotheses().select(
        "run_id", F.col("rank").cast("bigint").alias("rank"), "category", "score")


@query
def recommendations(spark, d):
    return offline(spark, d).recommendations().select(
        "run_id", "category", F.col("ord").cast("bigint").alias("ord"), "kind", "description",
        "mutates", "recommendation_id")


@query
def short_id(spark, d):
    return A.table(spark, d, "documents").select(
        "doc_id", text.short_id("concat('inc', substring(text, 1, 40))").alias("id"))


@query
def category_labels(spark, d):
    return triage(spark, d).groupBy("category").agg(F.count("*").alias("runs")).withColumn(
        "label", category_label("category"))


# --- assembly ---------------------------------------------------------------

@query
def investigate_runs(spark, d):
    """The whole chain, correlation on."""
    return investigation(spark, d).incidents().select(
        "run_id", "incident_id", "title", "platform", "pipeline", "failed_stage", "category",
        "confidence", "score", "summary", "status", F.array_join("notes", "|").alias("notes"),
        "meaningful", "related_issues", "reason", "token", "predates")


@query
def investigate_platforms(spark, d):
    """CI, cluster and dbt runs in one call, ids of the first two collide; changes of two platforms, issues of a third."""
    result = registry.investigate_sources(
        registry.ci_source(A.ci_runs(spark, d), A.ci_jobs(spark, d), A.ci_logs(spark, d), A.commits(spark, d)),
        registry.cluster_source(A.job_runs(spark, d)),
        registry.dbt_source(A.dbt_results(spark, d), A.dbt_nodes(spark, d)),
        registry.Source(changes=P.snowflake_changes(A.ddl_history(spark, d))),
        registry.issue_source(A.issue_records(spark, d)))
    return result.incidents().select(
        "platform", "run_id", "incident_key", "title", "pipeline", "failed_stage", "category", "confidence",
        "score", "summary", "status", "meaningful", "related_issues", "reason", "token", "predates")


@query
def incident_build(spark, d):
    return offline(spark, d).incidents().select(
        "run_id", "incident_id", "title", "platform", "pipeline", "failed_stage", "category",
        "confidence", "summary")


@query
def investigation_status(spark, d):
    return offline(spark, d).incidents().select("run_id", "status", "meaningful")


@query
def investigation_notes(spark, d):
    return offline(spark, d).incidents().select("run_id", F.explode("notes").alias("note"))


@query
def fail_gate(spark, d):
    return inv.fail_gate(offline(spark, d).incidents(), "medium").select(
        "run_id", "confidence", "score")


@query
def correlate_switch(spark, d):
    """Scores with correlation switched off although changes and issues exist."""
    return investigation(spark, d, correlate_evidence=False).incidents().select(
        "run_id", "category", "confidence", "score", "related_issues")


# --- streaming and trend ----------------------------------------------------

def _stream_lines(spark, d):
    schema = A.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return A.lines_of(raw)


def _drained(spark, stream, name):
    return watch.drain(stream, new_path(spark, name), new_path(spark, name + "-checkpoint"))


@query
def watch_triage(spark, d):
    return _drained(spark, watch.watch_triage(_stream_lines(spark, d)), "watch_triage").select(
        "run_id", "seq", "severity", "message", "category", "title")


@query
def watch_dedup(spark, d):
    """The alert stream, every repeat within the bound one alert, and per day the first line and the errors that it stands for."""
    alerts = _drained(spark, watch.watch_dedup(_stream_lines(spark, d), "60 days"), "watch_dedup")
    days = _daily_errors(spark, d)
    keys = ["platform", "run_id", "template"]
    return alerts.select(*keys, "severity").alias("a").join(
        days.alias("d"), [F.col(f"a.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys], "left").select(
        "day", *[f"a.{k}" for k in keys], "severity", "seq", "n_events")


def _daily_errors(spark, d):
    out = watch.drain_closed(lambda lines: watch.watch_error_counts(lines, "1 day", "1 hour"),
                             _stream_lines(spark, d), new_path(spark, "watch_errors"), "1 day", "1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "platform", "run_id",
                      "template", "seq", "n_events")


@query
def watch_error_counts(spark, d):
    return _daily_errors(spark, d)


@query
def watch_category_counts(spark, d):
    out = watch.drain_closed(lambda lines: watch.watch_category_counts(lines, "1 hour", "1 hour"),
                             _stream_lines(spark, d), new_path(spark, "watch_counts"), "1 hour", "1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "category",
                      "failures")


@query
def metric_regression(spark, d):
    """Events per pipeline and day against the seven days before."""
    daily = A.table(spark, d, "events").groupBy(
        F.expr(A.PIPELINE).alias("pipeline"), F.date_format("ts", "yyyy-MM-dd").alias("period")
    ).agg(F.count("*").cast("double").alias("value"))
    return trend.metric_regression(daily, threshold=1.5).select(
        "pipeline", "period", "value", "history", F.round("z_score", 6).alias("z_score"), "outlier")


def flat(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that results compare with the SQL types."""
    return df.select(*[
        F.col(f.name).cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name)
        for f in df.schema.fields])
