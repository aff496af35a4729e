"""Prompt-injection markers in untrusted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .dialect import java
from .parsing import group_or_null

_MARKERS = [java(p, True) for p in fixed.INJECTION_MARKERS]


def injection_markers(text: Column) -> Column:
    """Matched text per marker, in marker order."""
    return F.array_compact(F.array(*[group_or_null(text, p, 0) for p in _MARKERS]))


def neutralize(text: Column) -> Column:
    """Break code fences and drop role tags that could escape an envelope."""
    fenced = F.regexp_replace(text, F.lit("`{3,}"), F.lit("'''"))
    return F.regexp_replace(fenced, F.lit("(?i)</?(system|assistant|user)>"), F.lit(""))
