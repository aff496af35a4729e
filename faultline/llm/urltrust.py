"""URL filter: rules first, then trust and distrust carried along host links.

Rules name a host and a path prefix; the longest that fits a url decides. Where
none fits, the url's host is judged: trust flows from hosts with allowed pages
along links (personalised PageRank), distrust from hosts with blocked pages
against them, to the hosts that link there; a host is blocked where its
distrust reaches BLOCK_FROM and exceeds its trust.

Links are gathered from the pages' html, folded to one weighted edge for each
pair of hosts in the map tasks, and links within a host are left out. Each of
ROUNDS steps is a join of the edges with one row per host and an aggregate; a
step that changes nothing ends the loop. All of it is DataFrame functions.

Defined results: a url that is null or has no ``://`` has an empty host and
path, fits no rule, and its (empty) host is judged like any other; null html
has no links; repeated rows are judged alike (and count as pages of their own);
a null id is carried along; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.skew import one_per_key
from faultline.storage import materialize

DAMPING, ROUNDS = 0.85, 20
BLOCK_FROM = 0.02
#: (verdict, rule): the rule's host, then its path prefix from the first slash on.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, else null; of two as long, the one with the longer host."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[1])):
        name, prefix = rule[: rule.index("/")], rule[rule.index("/"):]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<verdict:string,rule:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links from pages of one host to another host. ``pages``: host, html."""
    link = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)"""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(link), 1)).alias("to"))
    dst = F.translate(F.regexp_extract("to", r"//([^/?#]*)", 1), _UPPER, _LOWER)
    return (links.select("src", dst.alias("dst")).filter("dst <> '' and src <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, score after ``rounds`` steps: (1 - damping) * seed + damping * shares of the hosts with an edge to it.

    ``seeds``: host, seed, one row for every host; ``edges``: src, dst, share.
    """
    restart = F.lit(1 - damping) * F.col("seed")
    scores = seeds.withColumn("score", restart)
    for _ in range(rounds):
        sent = edges.join(one_per_key(scores.filter("score > 0").select(F.col("host").alias("src"), "score"), "src"), "src")
        got = sent.groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = scores.select("host", "seed", F.col("score").alias("old")).join(
            got.withColumnRenamed("dst", "host"), "host", "left")
        new = new.withColumn("score", restart + F.lit(damping) * F.coalesce("got", F.lit(0.0))).drop("got")
        new = materialize(new, "scores")
        changed = new.filter("score <> old").limit(1).count()
        scores = new.drop("old")
        if not changed:
            break
    return scores.select("host", "score")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, damping: float = DAMPING,
               rounds: int = ROUNDS, block_from: float = BLOCK_FROM) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html)."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("found", _rule(F.col("host"), F.col("path"), RULES if rules is None else rules))
    edges = materialize(host_edges(rows), "edges")
    hosts = rows.groupBy("host").agg(
        F.avg(F.when(F.col("found.verdict") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
        F.avg(F.when(F.col("found.verdict") == "block", 1.0).otherwise(0.0)).alias("blocked"))
    known = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = hosts.join(known, "host", "full").na.fill(0.0, ["allowed", "blocked"])
    hosts = materialize(hosts, "hosts")

    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    forward = edges.join(one_per_key(out, "src"), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    back = edges.join(one_per_key(into, "dst"), "dst").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("total")).alias("share"))
    trust = propagate(hosts.select("host", F.col("allowed").alias("seed")), materialize(forward, "forward"), damping, rounds)
    distrust = propagate(hosts.select("host", F.col("blocked").alias("seed")), materialize(back, "back"), damping, rounds)
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host")
    bad = scores.filter((F.col("distrust") >= block_from) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(True).alias("bad"))

    judged = rows.drop("html").join(one_per_key(bad, "host"), "host", "left")
    by_host = F.when(F.col("bad"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce("found.verdict", by_host).alias("verdict"))
