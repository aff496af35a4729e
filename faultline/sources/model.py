"""Shapes of the normalised tables and small builders for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What identifies a run: ids are unique within a platform only.
RUN_KEY = ["platform", "run_id"]


def run_key(df) -> list[str]:
    """The key columns ``df`` has; a table of a single platform may leave that column out."""
    return [c for c in RUN_KEY if c in df.columns]


RUN_COLUMNS = ["run_id", "platform", "pipeline", "failed_stage", "status", "started_at",
               "finished_at", "duration_ms", "parameters", "source_ref", "baseline_id"]
EVENT_COLUMNS = ["run_id", "platform", "seq", "timestamp", "severity", "message", "source",
                 "code", "redacted"]
CHANGE_COLUMNS = ["ord", "id", "platform", "kind", "title", "timestamp", "author", "summary",
                  "source_ref"]


SOURCE_REF_TYPE = "struct<platform:string,native_id:string,url:string,locator:map<string,string>>"


def source_ref(platform: Column, native_id: Column, url: Column | None = None,
               **locator: Column) -> Column:
    pairs = [x for k, v in locator.items() for x in (F.lit(k), v)]
    return F.struct(
        platform.alias("platform"), native_id.alias("native_id"),
        (F.lit(None) if url is None else url).cast("string").alias("url"),
        (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,string>")
        .alias("locator"))


def run_row(run_id: Column, platform: Column, pipeline: Column, status: Column, ref: Column, *,
            failed_stage: Column | None = None, started_at: Column | None = None,
            finished_at: Column | None = None, duration_ms: Column | None = None,
            parameters: Column | None = None, baseline_id: Column | None = None) -> list[Column]:
    """The columns of a ``runs`` row, absent ones as typed nulls."""

    def opt(col, kind):
        return (F.lit(None) if col is None else col).cast(kind)

    return [
        run_id.cast("string").alias("run_id"), platform.alias("platform"),
        pipeline.alias("pipeline"), opt(failed_stage, "string").alias("failed_stage"),
        status.alias("status"), opt(started_at, "string").alias("started_at"),
        opt(finished_at, "string").alias("finished_at"),
        opt(duration_ms, "bigint").alias("duration_ms"),
        opt(parameters, "map<string,string>").alias("parameters"), ref.alias("source_ref"),
        opt(baseline_id, "string").alias("baseline_id"),
    ]


def event_struct(severity, message: Column, source: Column | None = None,
                 timestamp: Column | None = None, code_path: Column | None = None) -> Column:
    """An event without run and ``seq``; the position in its array is the seq."""
    none = F.lit(None).cast("string")
    return F.struct(
        (none if timestamp is None else timestamp).alias("timestamp"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        message.alias("message"),
        (none if source is None else source).alias("source"),
        (none if code_path is None else code_path).alias("code_path"))


def events_from_array(df, run_id: Column, platform: Column, events: Column):
    """Explode an array of ``event_struct`` into log events."""
    from ..functions.parsing import CODE_REF_TYPE

    return df.select(
        run_id.cast("string").alias("run_id"), platform.alias("platform"),
        F.posexplode(F.array_compact(events)).alias("pos", "e"),
    ).select(
        "run_id", "platform", F.col("pos").cast("bigint").alias("seq"), "e.timestamp",
        "e.severity", "e.message", "e.source",
        F.when(F.col("e.code_path").isNotNull(), F.struct(
            F.col("e.code_path").alias("path"), F.lit(None).cast("bigint").alias("line"),
            F.lit(None).cast("string").alias("symbol"))).cast(CODE_REF_TYPE).alias("code"),
        F.lit(False).alias("redacted"))
