"""Signature lists of any length: the literal index equals trying every signature on every event."""

import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.functions import fixed
from faultline.functions.literals import required_literals
from faultline.functions.signatures import signature_matches
from faultline.operators import classify, dedup
from faultline.operators.rules import indexed_matches, rule_index


@pytest.mark.parametrize("pattern, want", [
    (r"KeyError:\s*'([^']+)'", ["keyerror:"]),
    (r"(?:KeyError|ColumnNotFound).*?x", ["columnnotfound", "keyerror"]),
    (r"\<OOM\>", ["oom"]),
    (r"(?i)Out of\s+the memory", ["the memory"]),
    (r"(abc)?de", []),
    (r"(abc)+de", ["abc"]),
    (r"(abc){0,3}defg?", ["def"]),
    (r"abc|d.e", []),
    (r"abc(?=defgh)", ["abc"]),
    (r"(?!abcdef)xyz", ["xyz"]),
    (r"[abc]def", ["def"]),
    (r"grün und blau", ["n und blau"]),
    (r"(?iu)task", []),
    (r"(ab)\1cde", []),
    (r"abc{,2}d", []),
    (r"abc\Qd", []),
    (r"", []),
])
def test_required_literals(pattern, want):
    assert required_literals(pattern) == want


def test_required_literals_are_required():
    rng = random.Random(5)
    atoms = ["abc", "d", "ef", r"\d+", "(?:gh|ijk)", "(lmn)?", "[xy]", "(?:op)+", r"\b", ".*", "q{1,2}", "(?:rst|uvw)"]
    text = "abc d ef 12 gh ijk lmn x y op opop q qq rst uvw ABC".split()
    tried = 0
    for _ in range(3000):
        pattern = "".join(rng.choices(atoms, k=rng.randint(1, 5)))
        found = required_literals(pattern)
        said = "".join(rng.choices(text, k=rng.randint(1, 6)))
        if re.search(pattern, said, re.I):
            tried += 1
            assert not found or any(x in said.lower() for x in found), (pattern, said, found)
    assert tried > 300


def _rules(n):
    """A list of ``n`` signatures of all shapes, in the layout of ``fixed.SIGNATURES``."""
    shapes = [
        lambda i: (None, (1,), f"Stage {i} lost $1", rf"stage{i}\> lost (\w+)", True),
        lambda i: ("local" if i % 2 else "dbt", (2, 1), f"$2 of $1 {i}", rf"(?:job-{i}|task-{i}) (\d+)|unit {i}: (\w+)", False),
        lambda i: (None, (), f"plain {i}", rf"\<plain{i}\>", False),
        lambda i: (None, (1,), "$1", rf"(\w)\W{i}\W", False),
    ]
    out = []
    for i in range(n):
        only_on, groups, title, pattern, ci = shapes[i % 4](i)
        out.append((f"user.{i}", f"cat.{i % 7}", only_on, 40 + i % 60, groups, title, pattern, ci))
    return out


def _events(spark, n, rules, seed=1):
    rng = random.Random(seed)
    words = ["STAGE{} lost disk", "stage{} LOST net", "job-{} 12", "task-{} 3", "unit {}: w9", "plain{}", "plain{}x",
             "a-{}-", "é{}é", "nothing here", "", "KeyError: 'col_{}'", 'File "/a{}.py", line 7, in f']
    rows = [("r%d" % (i % 9), rng.choice(["local", "dbt", None]), i,
             None if i % 50 == 7 else " | ".join(rng.choice(words).format(rng.randrange(rules)) for _ in range(rng.randint(1, 4))))
            for i in range(n)]
    return spark.createDataFrame(rows, "run_id string, platform string, seq long, message string").withColumn(
        "code", F.expr("if(seq % 3 = 0, named_struct('path', 'p', 'line', seq, 'symbol', 's'), null)"))


def _rows(df):
    return sorted(map(repr, df.select("run_id", "seq", "m").collect()))


def _every(events, signatures, step=100):
    """Every signature on every event, by the array expression."""
    out = None
    for at in range(0, len(signatures), step):
        part = events.withColumn("m", F.explode(signature_matches(
            "message", "platform", "code", signatures, list(range(at, min(at + step, len(signatures)))))))
        out = part if out is None else out.unionByName(part)
    return out


def test_index_equals_every_signature_on_every_event(spark):
    signatures = _rules(300) + list(fixed.SIGNATURES)
    events = _events(spark, 600, 300)
    got = _rows(indexed_matches(events, "message", "platform", "code", signatures))
    assert got == _rows(_every(events, signatures))
    assert len(got) > 300  # not vacuous


def test_a_thousand_signatures(spark):
    signatures = _rules(1000)
    events = _events(spark, 2000, 1000, seed=2)
    found = indexed_matches(events, "message", "platform", "code", signatures)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Exchange hash" not in text
    got = {(r.seq, r.m.sig_ord) for r in found.select("seq", "m").collect()}
    want = set()
    compiled = [(re.compile(re.sub(r"\\[<>]", r"\\b", s[6]), re.A | (re.I if s[7] else 0)), s[2]) for s in signatures]
    for r in events.collect():
        for i, (pattern, only_on) in enumerate(compiled):
            if r.message is not None and pattern.search(r.message) and (
                    not only_on or r.platform is None or r.platform == only_on):
                want.add((r.seq, i))
    assert got == want and len(want) > 500


def test_index_edges(spark):
    events = _events(spark, 60, 10)
    for signatures in ([_rules(4)[0]], [("any", "c", None, 1, (), "t", ".", False)]):
        assert _rows(indexed_matches(events, "message", "platform", "code", signatures)) == _rows(
            _every(events, signatures))
    empty = events.limit(0)
    assert indexed_matches(empty, "message", "platform", "code", _rules(80)).count() == 0
    twice = _rules(3) + _rules(3)  # repeated signatures both match
    assert _rows(indexed_matches(events, "message", "platform", "code", twice)) == _rows(_every(events, twice))
    index, grams, always = rule_index(spark, _rules(80))
    assert index.count() >= len(grams) and all(0 <= i < 80 for i in always)


def test_triage_is_the_same_through_the_index(spark, monkeypatch):
    events = _events(spark, 400, 40).withColumn("platform", F.coalesce("platform", F.lit("local"))).filter(
        "message is not null").withColumns({
            "severity": F.lit("error"), "source": F.lit("s"), "n_hits": F.lit(1), "code": F.expr("cast(null as struct<path string, line bigint, symbol string>)")})
    signatures = _rules(40) + list(fixed.SIGNATURES)
    groups = dedup.template_groups(events, counters=True)
    results = {}
    for limit in (0, 10_000):
        monkeypatch.setattr(classify, "INDEX_FROM", limit)
        results[limit] = sorted(map(repr, classify.triage_runs(groups, signatures).collect()))
        results[limit, "m"] = sorted(map(repr, classify.signature_match(events, signatures).collect()))
    assert results[0] == results[10_000] and results[0, "m"] == results[10_000, "m"]
    assert results[0] and results[0, "m"]
