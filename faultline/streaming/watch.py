"""Watch mode: the same Column functions over a stream of log lines.

Lines need an event time ``ts`` of type timestamp (Structured Streaming takes
no timestamp without time zone).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, redaction, templates
from ..functions.signatures import signature_matches

#: Marks the row that closes the windows of a bounded drain.
CLOSING = "closing"


def watch_events(lines: DataFrame, level: str = "strict") -> DataFrame:
    """Severity, redaction: stateless, one row in, one row out."""
    line = F.col("line")
    events = lines.select(
        "run_id", "platform", "seq", "ts", parsing.parse_severity(line).alias("severity"),
        parsing.strip(line).alias("message"), F.lit(False).alias("redacted"),
        *[c for c in lines.columns if c == CLOSING])
    return redaction.redact_log_events(events, level)


def watch_triage(lines: DataFrame, level: str = "strict") -> DataFrame:
    """Error events with the category of their strongest signature, the earlier
    signature winning ties. Stateless."""
    matches = signature_matches(
        "message", "platform", f"cast(null as {parsing.CODE_REF_TYPE})")
    best = F.sort_array(F.transform(matches, lambda m: F.struct(
        (-m["weight"]).alias("order"), m["sig_ord"].alias("ord"),
        m["category"].alias("category"), m["title"].alias("title"))))
    return (
        watch_events(lines, level)
        .filter(parsing.is_error(F.col("severity")))
        .withColumn("best", F.try_element_at(best, F.lit(1)))
        .select("run_id", "platform", "seq", "ts", "severity", "message", "redacted",
                *[c for c in lines.columns if c == CLOSING],
                F.coalesce("best.category", F.lit("unknown")).alias("category"),
                F.col("best.title").alias("title"))
    )


def _templates(lines: DataFrame, level: str) -> DataFrame:
    return (
        watch_events(lines, level)
        .filter(parsing.is_error(F.col("severity")))
        .withColumn("template", templates.normalize_template(F.col("message")))
    )


def watch_dedup(lines: DataFrame, bound: str = "1 day", level: str = "strict") -> DataFrame:
    """The alert stream: one error per platform, run and template, its repeats
    within ``bound`` of event time dropped, across midnight too.

    The state holds one time per key and lets it go when the watermark, ``bound``
    behind the latest line, passes it; lines behind the watermark are late and
    raise no alert.
    """
    return (
        _templates(lines, level).withWatermark("ts", bound)
        .dropDuplicatesWithinWatermark(["platform", "run_id", "template"])
        .select("platform", "run_id", "template", "seq", "ts", "severity", "message", "redacted")
    )


def watch_error_counts(lines: DataFrame, bound: str = "1 day", delay: str = "1 hour",
                       level: str = "strict") -> DataFrame:
    """Errors per platform, run and template in tumbling windows of ``bound``.

    Repeats are folded in the map tasks, so a hot template never travels row
    by row, and state is dropped once the watermark passes the window.
    """
    return _open_windows(_templates(lines, level), bound, delay, ["platform", "run_id", "template"], [
        F.min("seq").alias("seq"), F.count("*").alias("n_events")])


def _open_windows(rows: DataFrame, bound: str, delay: str, keys: list[str], aggs: list) -> DataFrame:
    """Aggregates by window and key; the closing mark's own window is left out."""
    mark = [CLOSING] if CLOSING in rows.columns else []
    out = rows.withWatermark("ts", delay).groupBy(F.window("ts", bound), *keys, *mark).agg(*aggs)
    if mark:
        # A filter on the key itself would be pushed below the watermark, and the mark would not move it.
        out = out.select(*[c for c in out.columns if c != CLOSING], F.explode(F.array(CLOSING)).alias(CLOSING)) \
            .filter(~F.col(CLOSING))
    names = [c for c in out.columns if c not in ("window", CLOSING)]
    return out.select(F.col("window.start").alias("window_start"), *names)


def watch_category_counts(lines: DataFrame, every: str = "1 hour", delay: str = "1 hour",
                          level: str = "strict") -> DataFrame:
    """Failures per category and tumbling window; later rows are dropped."""
    return _open_windows(watch_triage(lines, level), every, delay, ["category"],
                         [F.count("*").alias("failures")])


def _run(stream: DataFrame, path: str, checkpoint: str) -> str | None:
    """Process what is available; the latest event time seen."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    seen = [p["eventTime"]["max"] for p in query.recentProgress if "max" in p["eventTime"]]
    return max(seen, default=None)


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is available, append it to ``path``, return it as a table.

    Windows still open at the last watermark stay in the state."""
    _run(stream, path, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_closed(build: Callable[[DataFrame], DataFrame], lines: DataFrame, folder: str,
                 bound: str, delay: str) -> DataFrame:
    """Process what is available of ``lines`` through ``build`` to the end: every window is emitted.

    A bounded drain leaves the last windows in the state, as no later line
    moves the watermark past them. So the lines are read together with a
    folder of closing marks: when all lines are processed, one mark behind the last window
    and the watermark's delay is written there and the query goes on from its
    checkpoint. The mark's own window never leaves the state. ``folder`` is on shared storage.
    """
    spark = lines.sparkSession
    marks, out, checkpoint = (f"{folder}/{name}" for name in ("marks", "out", "checkpoint"))
    schema = lines.schema
    spark.createDataFrame([], schema).write.parquet(marks)
    marked = lines.withColumn(CLOSING, F.lit(False)).unionByName(
        spark.readStream.schema(schema).parquet(marks).withColumn(CLOSING, F.lit(True)))
    stream = build(marked)
    last = _run(stream, out, checkpoint)
    if last is not None:
        values = {"ts": F.lit(last).cast("timestamp") + F.expr(f"interval {bound}") + F.expr(f"interval {delay}"),
                  "line": F.lit("ERROR closing")}
        spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                                for f in schema.fields]).write.mode("append").parquet(marks)
        _run(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)
