"""Weighted failure signatures as one array expression per event."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .dialect import SPACE_CHARS, java, text
from .literals import required_literals

_SPACES = text(SPACE_CHARS)


def _group(message: str, pattern: str, n: int) -> str:
    return f"nullif(regexp_extract({message}, {text(pattern)}, {n}), '')"


def _title(message: str, pattern: str, title: str) -> str:
    parts = re.split(r"\$(\d)", title)
    if len(parts) == 1:
        return text(title)
    pieces = [
        text(p) if i % 2 == 0 else f"regexp_extract({message}, {text(pattern)}, {p})"
        for i, p in enumerate(parts) if p != ""
    ]
    return f"trim(both {_SPACES} from concat({', '.join(pieces)}))"


def signature_matches(message: str, platform: str, code: str,
                      signatures: list[tuple] | None = None, only: list[int] | None = None,
                      low: str | None = None) -> Column:
    """Array of matches in signature order; empty when nothing matches.

    The arguments are SQL expressions. Patterns are literals, so each is
    compiled once per task; a signature table joined as rows would compile a
    pattern per row. ``signatures`` takes a user-supplied list in the layout of
    ``fixed.SIGNATURES``; ``only`` names the positions of it to try. ``low``
    names the lower-cased message: a signature then runs its pattern only where
    that holds a literal which the pattern requires. The expression grows with
    the list: see ``operators.rules`` for a long one.
    """
    items = []
    listed = fixed.SIGNATURES if signatures is None else signatures
    for ord_ in range(len(listed)) if only is None else only:
        sig, category, only_on, weight, groups, title, raw, ci = listed[ord_]
        pattern = java(raw, ci)
        hit = f"rlike({message}, {text(pattern)})"
        needed = required_literals(raw) if low else []
        if needed:
            hit = f"({' or '.join(f'contains({low}, {text(x)})' for x in needed)}) and {hit}"
        if only_on:
            hit = f"({platform} is null or {platform} = {text(only_on)}) and {hit}"
        token = "cast(null as string)"
        if groups:
            token = "coalesce(" + ", ".join(_group(message, pattern, g) for g in groups) + ")"
        ref = code
        if sig in fixed.SIGNATURE_CODE_GROUPS:
            p, n = fixed.SIGNATURE_CODE_GROUPS[sig]
            ref = (f"named_struct('path', regexp_extract({message}, {text(pattern)}, {p}), "
                   f"'line', try_cast(regexp_extract({message}, {text(pattern)}, {n}) as bigint), "
                   "'symbol', cast(null as string))")
        items.append(
            f"case when {hit} then named_struct('sig_ord', {ord_}, 'signature', {text(sig)}, "
            f"'category', {text(category)}, 'weight', {weight}, "
            f"'title', {_title(message, pattern, title)}, 'token', {token}, 'code', {ref}) end")
    return F.expr(f"array_compact(array({', '.join(items)}))")


def with_matches(events: DataFrame, message: str, platform: str, code: str,
                 signatures: list[tuple] | None = None, only: list[int] | None = None) -> DataFrame:
    """``events`` with ``matches``, the array of ``signature_matches``.

    A column of its own, to be exploded by name: a generator over the expression
    works out the type of the whole list again for each row.
    """
    low = events.select("*", F.expr(f"lower({message})").alias("__low"))
    return low.select(*events.columns, signature_matches(message, platform, code, signatures, only, "__low").alias("matches"))


def label_sql(category: str) -> str:
    labels = ", ".join(text(x) for kv in fixed.CATEGORY_LABELS.items() for x in kv)
    return f"try_element_at(map({labels}), {category})"


def category_label(category: str) -> Column:
    return F.expr(label_sql(category))
