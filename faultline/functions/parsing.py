"""Line-level parsing as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .dialect import SPACE_CHARS, java, java_any

_LEVEL = java(fixed.LEVEL_TOKEN)
_ERROR_LINE = java_any(fixed.ERROR_PATTERNS)
_CODE_REF = java(fixed.CODE_REF)
_TIMESTAMP = java(fixed.TIMESTAMP)

CODE_REF_TYPE = "struct<path:string,line:bigint,symbol:string>"


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(SPACE_CHARS))


def right_strip(col: Column) -> Column:
    return F.rtrim(col, F.lit(SPACE_CHARS))


def group_or_null(col: Column, pattern: str, group: int) -> Column:
    """``regexp_extract`` gives '' for an absent group; make it null."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def parse_severity(line: Column) -> Column:
    """First level token decides; without one an error-like text is an error."""
    levels = F.create_map(*[F.lit(x) for kv in fixed.LEVEL_SEVERITY.items() for x in kv])
    return F.coalesce(
        F.try_element_at(levels, F.regexp_extract(line, _LEVEL, 1)),
        F.when(line.rlike(_ERROR_LINE), F.lit("error")),
        F.lit("info"),
    )


def parse_timestamp(line: Column) -> Column:
    return group_or_null(line, _TIMESTAMP, 1)


def has_code_ref(line: Column) -> Column:
    # the literal test is cheap and spares most lines the regular expression
    return line.contains('File "') & line.rlike(_CODE_REF)


def parse_code_ref(line: Column) -> Column:
    """``File "p", line N, in sym`` -> struct, null when the line has none."""
    return F.when(
        has_code_ref(line),
        F.struct(
            F.regexp_extract(line, _CODE_REF, 1).alias("path"),
            F.regexp_extract(line, _CODE_REF, 2).try_cast("bigint").alias("line"),
            group_or_null(line, _CODE_REF, 3).alias("symbol"),
        ),
    )


def is_exception_line(line: Column) -> Column:
    """Same lines as ``(Error|Exception):``, by literal search."""
    return line.contains("Error:") | line.contains("Exception:")


def is_error(severity: Column) -> Column:
    return severity.isin("error", "fatal")


def split_lines(text: Column) -> Column:
    """Text -> array of its non-blank lines in order, not yet trimmed.

    The position in the array is the line's ``seq``: numbering happens inside
    the row, so no window over the log is needed.
    """
    return F.filter(F.split(text, r"\r?\n"), lambda x: strip(x) != "")
