"""Secret and PII redaction.

Each rule tests the text left by the previous rules, so the chain is built as
successive projections (Catalyst keeps them in one codegen stage) rather than
as one nested expression, which would repeat its input at every level.

Regular expressions dominate the cost on logs, so every rule has literals one of
which any match must contain. They are looked up in the lower-cased text, which
is lowered again only after a rule has changed it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .dialect import java, text

LEVELS = ("strict", "standard", "none")

_LITERALS = {
    "connection_string": ["://"],
    "aws_access_key_id": ["akia"],
    "aws_secret": ["aws_secret"],
    "github_token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "slack_token": ["xox"],
    "jwt": ["eyj"],
    "private_key": ["private key"],
    "authorization_header": ["authorization", "x-api-key"],
    "generic_secret_kv": ["passw", "pwd", "secret", "token", "key"],
    "email": ["@"],
}


def active_rules(level: str, only: str | None = None) -> list[tuple[str, str, str]]:
    """(name, Java pattern, replacement) of the rules in force at ``level``."""
    if level not in LEVELS:
        raise ValueError(f"unknown redaction level {level!r}")
    if level == "none":
        return []
    return [
        (name, java(pattern, ci), to)
        for name, pattern, ci, to, strict_only in fixed.REDACTION_RULES
        if (level == "strict" or not strict_only) and only in (None, name)
    ]


def redact_text(df: DataFrame, column: str, level: str = "strict", *, out: str | None = None,
                hits: str | None = "hits", n_hits: str | None = "n_hits",
                only: str | None = None) -> DataFrame:
    """Redact ``column`` of every row.

    ``hits`` receives the names of the rules that fired, ``n_hits`` their
    number (a hit is a rule firing on a row, not an occurrence). Apply once
    per text: a placeholder can itself look like a secret.
    """
    rules = active_rules(level, only)
    out = out or column
    keep = [f"`{c}`" for c in df.columns if c != out]
    steps = [f"`{column}` as __text0", f"lower(`{column}`) as __low0"]
    for i, (name, pattern, to) in enumerate(rules):
        possible = " or ".join(f"contains(__low{i}, {text(x)})" for x in _LITERALS[name])
        steps.append(f"coalesce(({possible}) and rlike(__text{i}, {text(pattern)}), false) as __hit{i}")
        steps.append(f"case when __hit{i} then regexp_replace(__text{i}, {text(pattern)}, {text(to)}) "
                     f"else __text{i} end as __text{i + 1}")
        steps.append(f"case when __hit{i} then lower(__text{i + 1}) else __low{i} end as __low{i + 1}")
    done = [f"'text', __text{len(rules)}"]
    if hits:
        names = ", ".join(f"case when __hit{i} then {text(r[0])} end" for i, r in enumerate(rules))
        done.append(f"'hits', array_compact(cast(array({names}) as array<string>))")
    if n_hits:
        done.append("'n_hits', " + (" + ".join(
            f"cast(__hit{i} as int)" for i in range(len(rules))) or "0"))
    # A filter on the result would be pushed through the chain and repeat each
    # step several times per later step; a generator keeps it above.
    work = df.selectExpr(*keep, *steps).selectExpr(
        *keep, f"explode(array(named_struct({', '.join(done)}))) as __done")
    cols = [f"__done.text as `{out}`" if c == out else f"`{c}`" for c in df.columns]
    if out not in df.columns:
        cols.append(f"__done.text as `{out}`")
    cols += [f"__done.hits as {hits}"] if hits else []
    cols += [f"__done.n_hits as {n_hits}"] if n_hits else []
    return work.selectExpr(*cols)


def redact_sql(value: str, level: str = "strict") -> str:
    """Redacted text only, as one SQL expression (for map values)."""
    for _, pattern, to in active_rules(level):
        value = f"regexp_replace({value}, {text(pattern)}, {text(to)})"
    return value


def redact_log_events(events: DataFrame, level: str = "strict") -> DataFrame:
    """Redact ``message``; ``redacted`` turns true where a rule fired.

    Rows that already carry ``redacted = true`` went through a redacting source
    and are still scanned: the flag only ever accumulates.
    """
    out = redact_text(events, "message", level, hits=None)
    return out.selectExpr(*["redacted or n_hits > 0 as redacted" if c == "redacted" else c
                            for c in out.columns])


def redaction_counts(redacted: DataFrame) -> DataFrame:
    """Rule hits per run over every severity."""
    return redacted.groupBy("run_id").agg(F.sum("n_hits").cast("bigint").alias("hit_count"))


def mask_fields(values: str, fields: list[str], level: str = "strict") -> Column:
    """Map column ``values``: named keys are masked, other values redacted."""
    named = ", ".join(text(f.lower()) for f in fields)
    return F.expr(f"transform_values({values}, (k, v) -> case when lower(k) in ({named}) "
                  f"then {text(fixed.MASKED_FIELD)} else {redact_sql('v', level)} end)")
