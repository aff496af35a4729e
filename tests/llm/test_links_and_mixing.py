"""URL trust, mixing, and the pipeline's stages: against plain versions, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import langid, minhash, mixing, queries, stages, urltrust
from tests.llm.test_text_operators import DOCS, run


def test_urls_rules_and_propagation(spark):
    link = '<a href="http://{0}/x">x</a>'
    pages = [
        (1, "http://A.Example.ORG/en/2?q#f", link.format("good.net")), (2, "https://example.org/es/1", None),
        (3, "x://sub.example.org/en/19", ""), (4, "http://shop.com/de/a", link.format("Shop2.com")), (5, "http://shop.com/en/", None),
        (6, "http://farm.net/a", link.format("shop.com") * 3 + "<a href='//good.net/b'>"), (7, "http://good.net/b", '<A HREF = /de/>'),
        (8, None, link.format("shop.com")), (9, "no scheme", None), (10, "http://notorg/", None), (11, "http://org?x", None),
        (None, "http://q.org/a://b", None), (5, "http://shop.com/en/", None),
    ]
    table = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, html string, host string")
    rows = run(urltrust.judge_urls, spark, table).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("a.example.org", "/en/2", "org/", "allow")
    assert got[2][2:] == ("example.org/es/", "block") and got[3][2:] == ("example.org/en/1", "block")
    assert got[4][2:] == ("com/de/", "block") and got[None] == ("q.org", "/a://b", "org/", "allow")
    assert got[8] == got[9] == ("", "", None, "allow") and got[10][2] is None and got[11] == ("org", "", None, "allow")
    assert got[5][3] == "block"  # a host with blocked pages
    assert got[6][3] == "block"  # links to a blocked host
    assert got[7][3] == "allow"  # linked by an allowed one
    assert run(urltrust.judge_urls, spark, table.limit(0)).count() == 0


def test_propagation_equals_dense_steps(spark):
    rng = np.random.default_rng(7)
    w = rng.random((12, 12)) * (rng.random((12, 12)) < 0.3)
    np.fill_diagonal(w, 0)
    share = w / np.maximum(w.sum(1, keepdims=True), 1e-12)
    seed = rng.random(12)
    want = 0.15 * seed
    for _ in range(urltrust.ROUNDS):
        want = 0.15 * seed + 0.85 * share.T @ want
    seeds = spark.createDataFrame([(f"h{i}", float(s)) for i, s in enumerate(seed)], "host string, seed double")
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", float(share[i, j])) for i, j in zip(*np.nonzero(share))], "src string, dst string, share double")
    got = {r.host: r.score for r in urltrust.propagate(seeds, edges).collect()}
    assert [got[f"h{i}"] for i in range(12)] == pytest.approx(want.tolist())


def test_rates_meet_reachable_targets(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.4] * 3, 400)
    t = rng.integers(1, 900, 400)
    table = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "tokens long, p array<double>")
    target = np.array([0.6, 0.3, 0.1]) * t.sum()
    steps = run(mixing.solve, spark, table, target, float("inf"))
    rate = mixing.rates(p, steps, float("inf"))
    assert (rate >= 0).all() and (rate * t) @ p == pytest.approx(target, rel=1e-4)
    # with rates of at most 1: what is in reach is met
    low = (np.clip(0.9 - p[:, 2] - 0.5 * p[:, 1] + rng.normal(0, 0.05, 400), 0, 1) * t) @ p
    rate = mixing.rates(p, run(mixing.solve, spark, table, low, 1.0), 1.0)
    assert rate.max() <= 1 and (rate * t) @ p == pytest.approx(low, rel=1e-3)
    # out of reach: no feasible neighbour is clearly better
    high = np.array([0.2, 0.9, 0.2]) * t.sum()
    rate = mixing.rates(p, run(mixing.solve, spark, table, high, 1.0), 1.0)
    inverse = np.linalg.inv((p * t[:, None]).T @ p)

    def loss(r):
        e = (r * t) @ p - high
        return e @ inverse @ e

    for _ in range(50):
        assert loss(np.clip(rate + rng.normal(0, 0.02, 400), 0, 1)) >= loss(rate) * 0.97
    assert loss(np.ones(400)) > loss(rate)


def test_mixing_query_meets_the_targets(spark):
    rows = queries.QUERIES["op10_soft_mixing"](spark, "/root/testdata/sf0.01")
    domains = [f"p_{d}" for d in mixing.DOMAINS]
    got = rows.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col(c)) for c in domains], F.sum("tokens")).first()
    want = [queries.MIX[d] * got[3] for d in mixing.DOMAINS]
    assert list(got)[:3] == pytest.approx(want, rel=1e-3)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "good words here", "x"), (3, "good words here", "x"), (None, "z " * 50, None)],
                                 "doc_id long, text string, tokens string")
    labels = spark.createDataFrame([(3, 1, 0), (3, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    domain = mixing.label_domain(F.col("quality"), F.col("toxic"))
    model = run(mixing.train, spark, docs, labels, domain, mixing.DOMAINS)
    rows = run(mixing.mix, spark, docs, model, queries.MIX).collect()
    assert len(rows) == 5 and all(r.rate >= 0 and r.copies >= 0 for r in rows)
    assert all(r.rate == 1.0 and r.copies == 1 for r in rows if r.tokens == 0)
    assert len({r.rate for r in rows if r.row.doc_id == 3}) == 1
    assert run(mixing.mix, spark, docs.limit(0), model, queries.MIX).count() == 0
    blank = run(mixing.train, spark, docs, labels.limit(0), domain, mixing.DOMAINS)
    assert run(mixing.mix, spark, docs, blank, queries.MIX).first().p == pytest.approx([1 / 3] * 3)


def test_stages_keep_the_columns_and_their_decisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    extra = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "12 34", "en", "s", 5), (None, None, "en", None, None)], DOCS)
    docs = docs.unionByName(extra)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "minhash_near_dedup", "soft_mixing", "best_fit_packing"]
    first = stages.language_id(spark, docs, sf)
    assert first.columns == docs.columns
    assert first.filter("doc_id >= 900000 or doc_id is null").count() == 0 and first.count() == 150
    second = stages.line_dedup(spark, first, sf)
    assert second.columns == docs.columns and second.count() == 150
    third = stages.minhash_near_dedup(spark, second, sf)
    assert third.columns == docs.columns
    alone = {r.component_id for r in run(minhash.near_duplicates, spark, second, 5, 80).collect()}
    assert {r.doc_id for r in third.collect()} == alone
    fourth = stages.soft_mixing(spark, third, sf)
    assert fourth.columns == docs.columns and 0 < fourth.count() <= third.count()
    packed = stages.best_fit_packing(spark, fourth, sf)
    assert packed.select("doc_id").distinct().count() == fourth.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert langid.UND not in {r.lang for r in first.collect()}
