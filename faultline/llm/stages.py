"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> documents, or packed pieces for the last.

Every stage takes null, empty and repeated rows, an empty table, and columns of any further name, which it
returns unchanged: language_id drops null and letterless texts (``und``); line_dedup keeps a null text null;
minhash_near_dedup keeps every text without words, and one row of those repeated; soft_mixing keeps texts without
tokens; best_fit_packing makes one piece of an empty or null text (its end mark). An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import langid, linededup, minhash, mixing, packing
from faultline.llm.common import importable, release, table

#: A text whose best language is less likely than this is rejected.
MIN_LANGUAGE_SCORE = 0.2
#: Shares of the domains after mixing.
MIX = {"good": 0.90, "low": 0.08, "toxic": 0.02}


@importable
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``und`` and undecided ones go."""
    release(spark)
    judged = langid.predict(docs, langid.train(docs))
    kept = (F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return judged.filter(kept).select(*[F.col("row")[c].alias(c) for c in docs.columns])


@importable
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without recurring lines; ``n_chars`` follows the text."""
    release(spark)
    out = linededup.drop_recurring_lines(docs)
    values = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed = F.col("n_dropped") > 0
        kind = docs.schema["n_chars"].dataType
        values["n_chars"] = F.when(changed, F.length("text").cast(kind)).otherwise(F.col("row")["n_chars"])
    return out.select(*[v.alias(c) for c, v in values.items()])


@importable
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    release(spark)
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


@importable
def soft_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn at rates of at most 1 that bring the domains to their target weights."""
    release(spark)
    domain = mixing.label_domain(F.col("quality"), F.col("toxic"))
    model = mixing.train(docs, table(spark, sf_dir, "labels"), domain, mixing.DOMAINS)
    drawn = mixing.mix(docs, model, MIX, max_rate=1.0).filter("copies > 0")
    return drawn.select(*[F.col("row")[c].alias(c) for c in docs.columns])


@importable
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces in sequences of at most 2048 tokens."""
    release(spark)
    return packing.pack(packing.pieces(docs, 2048), 2048)
