"""Attach the pending traceback frame to the exception line that follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..sources.model import run_key

BLOCK_ROWS = 1_000_000


def attach_frame(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``code``: a frame line's own reference, or, on an exception line of
    severity ``error``, the frame that is still pending.

    An exception line consumes the pending frame, so among frame and exception
    lines only the direct predecessor matters: a lag, not a running scan. Only
    those lines are shuffled. A run may hold most of the log, so the lag runs
    per block of ``block_rows`` sequence numbers. The first line of a block
    takes its predecessor from a second lag, over the first and last lines of
    the run's blocks alone. The log is read twice, once for those lines and
    once for all others; nothing is joined.
    """
    message = F.col("message")
    marked = events.withColumn("__frame", parsing.has_code_ref(message)).withColumn(
        "__raise",
        ~F.col("__frame") & parsing.is_exception_line(message) & (F.col("severity") == "error"),  # the dear test last
    )
    traced = F.col("__frame") | F.col("__raise")
    plain = marked.filter(~traced).withColumn("code", F.lit(None).cast(parsing.CODE_REF_TYPE))

    lines = (
        marked.filter(traced)
        .withColumn("__ref", parsing.parse_code_ref(message))
        .withColumn("__block", F.floor(F.col("seq") / F.lit(block_rows)))
    )
    own = run_key(events)
    in_block = Window.partitionBy(*own, "__block").orderBy("seq")
    at_edge = Window.partitionBy(*own, "__inside").orderBy("seq")
    resolved = (
        lines.withColumns({
            "__prev": F.lag("__ref").over(in_block),
            "__head": F.row_number().over(in_block) == 1,
            "__tail": F.lead(F.lit(True), 1, False).over(in_block) == False})  # noqa: E712
        .withColumn("__inside", F.when(~F.col("__head") & ~F.col("__tail"), F.col("__block")))
        .withColumn("__carry", F.lag("__ref").over(at_edge))
        .withColumn("code", F.when(F.col("__frame"), F.col("__ref"))
                    .when(F.col("__head"), F.col("__carry"))
                    .otherwise(F.col("__prev")))
    )
    out = events.columns + ["code"]
    return plain.select(*out).unionByName(resolved.select(*out))
