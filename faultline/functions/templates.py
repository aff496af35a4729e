"""Message templates and cascade phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .dialect import java, java_any
from .parsing import strip

_STEPS = [(java(p, ci), to) for p, ci, to in fixed.TEMPLATE_STEPS]
_CASCADE = java_any([(p, True) for p in fixed.CASCADE_PHRASES])


def normalize_template(message: Column) -> Column:
    out = message
    for pattern, replacement in _STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    return F.lower(strip(out))


def is_cascade(message: Column) -> Column:
    """The line reports an effect (a task, stage or job failed), not a cause."""
    return strip(message).rlike(_CASCADE)
