"""Several platforms as one: what their sources give, united.

A source is whatever tables a platform has. ``combine`` unites them to the
inputs of ``investigate``; the key (platform, run_id) keeps equal ids of two
platforms apart, so every run gets an incident of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import CODE_REF_TYPE
from ..plans.investigate import Investigation, investigate
from . import platforms as P
from .model import EVENT_COLUMNS, RUN_COLUMNS, SOURCE_REF_TYPE

_RUN_TYPES = {"duration_ms": "bigint", "parameters": "map<string,string>", "source_ref": SOURCE_REF_TYPE}
_EVENT_TYPES = {"seq": "bigint", "code": CODE_REF_TYPE, "redacted": "boolean"}
_CONFIG_COLUMNS = ["platform", "run_id", "ord", "kind", "values"]


@dataclass(frozen=True)
class Source:
    """The tables of one platform; a source of changes or issues alone has no runs."""

    runs: DataFrame | None = None
    events: DataFrame | None = None
    configs: DataFrame | None = None
    changes: DataFrame | None = None
    issues: DataFrame | None = None


def ci_source(runs: DataFrame, jobs: DataFrame, logs: DataFrame, commits: DataFrame | None = None) -> Source:
    return Source(P.gha_runs(runs, jobs), P.gha_events(logs), changes=None if commits is None else P.gha_changes(commits))


def cluster_source(jobs: DataFrame) -> Source:
    return Source(P.databricks_runs(jobs), P.databricks_events(jobs), P.databricks_configs(jobs))


def warehouse_source(queries: DataFrame, ddl: DataFrame | None = None) -> Source:
    return Source(P.snowflake_runs(queries), P.snowflake_events(queries), P.snowflake_configs(queries),
                  None if ddl is None else P.snowflake_changes(ddl))


def store_source(operations: DataFrame) -> Source:
    return Source(P.mongo_runs(operations), P.mongo_events(operations))


def dbt_source(results: DataFrame, nodes: DataFrame | None = None) -> Source:
    return Source(P.dbt_runs(results), P.dbt_events(results, nodes))


def issue_source(records: DataFrame) -> Source:
    return Source(issues=P.issues_normalize(records))


def _shaped(df: DataFrame, columns: list[str], types: dict[str, str]) -> DataFrame:
    """``df`` with exactly ``columns``; those it lacks are typed nulls."""
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in columns])


def combine(*sources: Source) -> Source:
    """One source with the tables of all; changes keep the order of the sources."""

    def union(parts: list[DataFrame]) -> DataFrame | None:
        return reduce(DataFrame.unionByName, parts) if parts else None

    held = {f.name: [getattr(s, f.name) for s in sources if getattr(s, f.name) is not None] for f in fields(Source)}
    return Source(
        union([_shaped(d, RUN_COLUMNS, _RUN_TYPES) for d in held["runs"]]),
        union([_shaped(d, EVENT_COLUMNS, _EVENT_TYPES) for d in held["events"]]),
        union([d.select(*_CONFIG_COLUMNS) for d in held["configs"]]),
        P.changes_union(*held["changes"]) if held["changes"] else None,
        union(held["issues"]))


def investigate_sources(*sources: Source, **options) -> Investigation:
    """Every run of every source, investigated with the changes and issues of all."""
    every = combine(*sources)
    return investigate(every.runs, every.events, configs=every.configs, changes=every.changes,
                       issues=every.issues, **options)
