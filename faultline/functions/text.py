"""Token sets, Jaccard similarity and short identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens of more than two characters."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """|A∩B| / |A∪B| of two distinct-token arrays, 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        common / (F.size(a) + F.size(b) - common))


def jaccard_similarity(a: Column, b: Column) -> Column:
    return jaccard(tokenize(a), tokenize(b))


def short_id_sql(seed: str) -> str:
    """32-bit FNV-1a over UTF-16 units, base 36, seven characters."""
    units = f"regexp_extract_all(hex(encode({seed}, 'UTF-16BE')), '.{{4}}', 0)"  # cut once, not once a unit
    return f"""substring(lpad(lower(conv(cast(aggregate(
        {units}, 2166136261L, (h, c) -> ((h ^ cast(conv(c, 16, 10) as bigint)) * 16777619L) & 4294967295L
        ) as string), 10, 36)), 7, '0'), 1, 7)"""


def short_id(seed: str) -> Column:
    return F.expr(short_id_sql(seed))
