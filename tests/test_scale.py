"""Hot groups, block boundaries, and exactness against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import classify, compare, correlate, dedup, frames
from faultline.functions import parsing, redaction
from faultline.sources import logs
from faultline.streaming import watch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joined_without_pairs(df):
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_frames_cross_block_boundaries(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for run in ("a", "b"):
        pending = None
        for seq in range(300):
            kind = rng.choice("frame exc exc2 info info info".split())
            if kind == "frame":
                message, severity, ref = f'File "/m{seq}.py", line {seq}, in f', "info", seq
                pending, code = ref, ref
            elif kind == "exc":
                message, severity = "ValueError: x", "error"
                code, pending = pending, None
            elif kind == "exc2":      # fatal lines never take a frame
                message, severity, code = "FATAL KeyError: y", "fatal", None
            else:
                message, severity, code = "INFO z", "info", None
            rows.append((run, seq, severity, message))
            want[(run, seq)] = code
    df = spark.createDataFrame(rows, "run_id string, seq long, severity string, message string")
    for block in (1, 7, 1000):
        got = {(r.run_id, r.seq): r.code and r.code.line
               for r in frames.attach_frame(df, block_rows=block).collect()}
        assert got == want
    text = plan(frames.attach_frame(df))
    assert "Join" not in text and text.count("Scan ExistingRDD") == 2


def test_read_log_lines_numbers_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) if i % 7 else "   " for i in range(4000)]
    for name in ("one.log", "two.log"):
        (tmp_path / name).write_text("\r\n".join(lines) + "\r\n")
    (tmp_path / "small.log").write_text("only\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = logs.read_log_lines(spark, str(tmp_path))
        got = {}
        for r in df.collect():
            got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.seq, r.line))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    kept = [x.rstrip() for x in lines if x.strip()]
    for name in ("one.log", "two.log"):
        assert sorted(got[name]) == list(enumerate(kept))
    assert got["small.log"] == [(0, "only")]


@pytest.mark.parametrize("cells", [2, 4096])
@pytest.mark.parametrize("threshold", [0.05, 0.3])
def test_similar_incidents_equals_brute_force(spark, monkeypatch, cells, threshold):
    monkeypatch.setattr(correlate, "CELL_RUNS", cells)
    monkeypatch.setattr(correlate, "CELL_ISSUES", cells)
    rng = random.Random(7)
    words = [f"word{i}" for i in range(40)]
    # "hot" is in every run and every issue; one run is far too large to match
    runs = {f"r{i}": {"hot"} | set(rng.sample(words, rng.randint(0, 25))) for i in range(30)}
    runs["huge"] = {"hot"} | {f"big{i}" for i in range(400)}
    issues = {f"I{i}": {"hot"} | set(rng.sample(words, rng.randint(1, 6))) for i in range(20)}
    seeds = spark.createDataFrame(
        [(r, t) for r, ts in runs.items() for t in ts], "run_id string, token string")
    table = spark.createDataFrame(
        [(k, " ".join(sorted(ts)), []) for k, ts in issues.items()],
        "key string, title string, labels array<string>")
    got = {(r.run_id, r.issue_key): r.similarity
           for r in correlate.similar_incidents(seeds, table, threshold).collect()}
    want = {}
    for r, a in runs.items():
        for k, b in issues.items():
            s = len(a & b) / len(a | b)
            if s >= threshold:
                want[(r, k)] = s
    assert got == pytest.approx(want) and got.keys() == want.keys()
    joined_without_pairs(correlate.similar_incidents(seeds, table, threshold))


def test_change_correlate_equals_brute_force(spark):
    rng = random.Random(5)
    alphabet = "abAB_é "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    needles = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    changes = spark.createDataFrame(
        [(i, f"c{i}", "commit", t[:6], t[6:] or None, "2024-01-02") for i, t in enumerate(texts)],
        "ord int, id string, kind string, title string, summary string, timestamp string")
    tokens = spark.createDataFrame(
        [(f"r{i}", n, "2024-01-01" if i % 2 else "2024-01-03") for i, n in enumerate(needles)],
        "run_id string, token string, started_at string")
    out = correlate.change_correlate(tokens, changes)
    got = {r.run_id: (r.change_id, r.predates) for r in out.collect()}
    want = {}
    for i, n in enumerate(needles):
        for j, t in enumerate(texts):
            if n.lower() in (t[:6] + " " + t[6:]).lower():
                want[f"r{i}"] = (f"c{j}", i % 2 == 0)
                break
    assert got == want
    joined_without_pairs(out)


def events(spark, rows):
    df = spark.createDataFrame(
        rows, "run_id string, platform string, seq long, severity string, message string")
    return df.withColumn("source", F.lit(None).cast("string")).withColumn(
        "code", F.lit(None).cast(parsing.CODE_REF_TYPE)).withColumn("redacted", F.lit(False))


def triage(df):
    return classify.triage_runs(
        dedup.template_groups(redaction.redact_log_events(df), counters=True))


def test_dedup_rules(spark):
    df = events(spark, [
        ("a", "local", 0, "error", "Traceback (most recent call last)"),
        ("a", "local", 1, "error", "KeyError: 'customer_region'"),
        ("a", "local", 2, "error", "KeyError: 'customer_region'"),
        ("a", "local", 3, "error", "Job run failed"),
        ("b", "local", 0, "error", "Job run failed"),
        ("b", "local", 1, "error", "Job run failed"),
        ("b", "local", 2, "fatal", "Task 7 exited"),
        ("c", "local", 0, "info", "password=hunter2"),
    ])
    kept = {(r.run_id, r.seq) for r in dedup.dedup_errors(df).collect()}
    assert kept == {("a", 1), ("b", 0), ("b", 2)}
    by_run = {r.run_id: r for r in triage(df).collect()}
    a, b, c = by_run["a"], by_run["b"], by_run["c"]
    assert (a.removed_duplicates, a.removed_cascades, a.meaningful, a.reason) == (
        1, 2, 1, "signature")
    assert (b.removed_duplicates, b.removed_cascades, b.meaningful, b.reason) == (
        1, 0, 2, "first_error")
    assert (c.hit_count, c.errors, c.category, c.earliest_seq) == (1, 0, "unknown", None)


def test_hot_run_is_folded_before_the_shuffle(spark):
    """One run holds most rows; its template groups leave the map side small."""
    big = spark.range(200_000, numPartitions=4).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 100))
        .alias("run_id"), F.lit("local").alias("platform"), F.col("id").alias("seq"),
        F.lit("error").alias("severity"),
        F.concat(F.lit("ERROR step "), F.col("id"), F.lit(" timed out")).alias("message"),
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast(parsing.CODE_REF_TYPE).alias("code"), F.lit(False).alias("redacted"))
    got = dedup.dedup_counters(dedup.template_groups(big)).filter("run_id = 'hot'").first()
    assert (got.errors, got.templates, got.removed_duplicates) == (140_000, 1, 139_999)
    assert plan(dedup.template_groups(big)).count("partial_min_by") >= 1


def test_skewed_join_is_split(spark):
    """A run with most of the messages: adaptive execution splits its side."""
    keep = {k: spark.conf.get(k, None) for k in (
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
        "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(40_000, numPartitions=8).select(
            F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("r"), F.col("id")))
            .alias("run_id"), F.col("id").alias("seq"), F.lit("error").alias("severity"),
            F.concat(F.lit("boom "), F.hex("id"), F.lit("z")).alias("message"))
        pairs = rows.select("run_id").distinct().withColumn(
            "baseline_id", F.concat(F.lit("base-"), "run_id"))
        out = compare.new_errors(rows, pairs)
        assert out.count() == 40_000
        executed = out.select("run_id", "message")
        executed.collect()
        text = executed._jdf.queryExecution().executedPlan().toString()
        assert text.split("Initial Plan")[0].count("skew=true") >= 1
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_diff_later_snapshot_wins_and_absent_differs(spark):
    runs = spark.createDataFrame(
        [("f", "local", "b", {"p": "1", "same": "x"}), ("b", "local", None, {"q": "2", "same": "x"})],
        "run_id string, platform string, baseline_id string, parameters map<string,string>")
    configs = spark.createDataFrame([
        ("f", 0, "dependencies", {"lib": "1"}), ("f", 1, "libraries", {"lib": "2"}),
        ("b", 0, "libraries", {"lib": "3"}), ("b", 1, "runtime", {"py": "3.11"})],
        "run_id string, ord int, kind string, values map<string,string>")
    pairs = compare.baseline_link(runs)
    got = {(r.section, r.key, r.before, r.after) for r in
           compare.diff_records(compare.run_entries(runs, configs), pairs).collect()}
    assert got == {
        ("parameters", "p", None, "1"), ("parameters", "q", "2", None),
        ("dependencies", "lib", "3", "2"), ("environment", "py", "3.11", None),
        ("configuration", "runtime.py", "3.11", None)}


def test_watch_counts_over_several_files(spark, tmp_path):
    source = tmp_path / "in"
    lines = spark.range(120).select(
        F.lit("r").alias("run_id"), F.lit("local").alias("platform"), F.col("id").alias("seq"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.concat(F.lit("ERROR connection timed out after "), F.col("id")).alias("line"))
    lines.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(lines.schema).parquet(str(source))
    out = watch.drain(watch.watch_category_counts(stream, "10 minutes", "10 minutes"),
                      str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = out.orderBy("window_start").collect()
    # windows that end by the final watermark (119 min - 10 min)
    assert [(r.category, r.failures) for r in rows] == [("network.timeout", 10)] * 10
    once = watch.drain(watch.watch_error_counts(stream, "1 hour", "10 minutes"),
                       str(tmp_path / "out2"), str(tmp_path / "cp2")).collect()
    assert [(r.seq, r.n_events) for r in once] == [(0, 60)]


def test_equal_run_ids_of_two_platforms_stay_apart(spark):
    runs = spark.createDataFrame(
        [("f", "local", "b", {"p": "1"}), ("b", "local", None, {"p": "2"}),
         ("f", "dbt", "b", {"p": "5"}), ("b", "dbt", None, {"p": "5"})],
        "run_id string, platform string, baseline_id string, parameters map<string,string>")
    events = spark.createDataFrame(
        [("f", "local", 1, "error", "disk full"), ("b", "dbt", 1, "error", "disk full"),
         ("f", "dbt", 1, "error", "disk full")],
        "run_id string, platform string, seq long, severity string, message string")
    pairs = compare.baseline_link(runs)
    diff = compare.diff_records(compare.run_entries(runs, None), pairs).collect()
    assert [(r.platform, r.run_id, r.before, r.after) for r in diff] == [("local", "f", "2", "1")]
    new = compare.new_errors(events, pairs).collect()
    assert [(r.platform, r.run_id, r.message) for r in new] == [("local", "f", "disk full")]


def test_change_correlate_is_linear_in_the_text(spark):
    """Long texts, thousands of tokens with one beginning: seconds, and the same as a plain search."""
    import time

    rng = random.Random(9)
    long = " ".join(f"col_{rng.randint(0, 9_000)}" for _ in range(6_000))[:50_000]
    texts = [long, "é" * 49_000 + " col_9501 tail", "x" * 255 + "boundary_token" + "y" * 300, ""]
    needles = [f"col_{i}" for i in range(5_000)] + ["COL_9501", "boundary_token", "z" * 900, "y" * 300, "é" * 600, "col_", "c"]
    changes = spark.createDataFrame(
        [(i, f"c{i}", "commit", t, None, "2024-01-02") for i, t in enumerate(texts)],
        "ord int, id string, kind string, title string, summary string, timestamp string")
    tokens = spark.createDataFrame([(f"r{i}", n, "2024-01-03") for i, n in enumerate(needles)],
                                   "run_id string, token string, started_at string")
    start = time.time()
    got = {r.run_id: r.change_id for r in correlate.change_correlate(tokens, changes).collect()}
    assert time.time() - start < 60
    want = {}
    for i, n in enumerate(needles):
        found = next((j for j, t in enumerate(texts) if n.lower() in (t + " ").lower()), None)
        if found is not None:
            want[f"r{i}"] = f"c{found}"
    assert got == want


@pytest.mark.parametrize("threshold", [0.05, 0.3])
def test_related_issues_equal_the_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(correlate, "CELL_RUNS", 3)
    monkeypatch.setattr(correlate, "CELL_ISSUES", 2)
    rng = random.Random(8)
    words = [f"word{i}" for i in range(30)]
    runs = {f"r{i}": {"hot"} | set(rng.sample(words, rng.randint(0, 12))) for i in range(25)}
    runs |= {f"same{i}": {"hot", "word1", "word2", f"own{i}"} for i in range(40)}
    issues = [(f"I{i}", 90 - i, " ".join(sorted({"hot"} | set(rng.sample(words, rng.randint(1, 5)))))) for i in range(25)]
    issues += [(f"J{i}", i, "hot word1") for i in range(6)]
    seeds = spark.createDataFrame([(p, r, t) for r, ts in runs.items() for p in ("local", "dbt")[: 1 + (r == "r3")] for t in ts],
                                  "platform string, run_id string, token string")
    table = spark.createDataFrame([(k, o, t, []) for k, o, t in issues], "key string, ord long, title string, labels array<string>")
    want = {}
    for r, a in runs.items():
        found = []
        for k, o, t in issues:
            b = set(t.split())
            s = len(a & b) / len(a | b)
            if s >= threshold:
                found.append((-s, o, k))
        if found:
            want[r] = (len(found), [k for _, _, k in sorted(found)[:3]])
    out = correlate.related_issues(seeds, table, 3, threshold)
    rows = out.collect()
    assert {r.run_id: (r.n_related, [x.issue_key for x in r.top]) for r in rows} == want
    assert sum(r.run_id == "r3" for r in rows) == 2 * ("r3" in want)
    joined_without_pairs(out)


def test_a_hot_token_joins_sets_not_pairs(spark):
    """400 runs and 300 issues share a token; what is compared are the few distinct sets."""
    seeds = spark.range(400).selectExpr("cast(id as string) as run_id",
                                        "explode(array('hot', concat('kind', id % 5), concat('own', id))) as token")
    issues = spark.range(300).selectExpr("concat('I', id) as key", "id as ord", "concat('hot kind', id % 4) as title",
                                         "array() as labels").withColumn("labels", F.expr("cast(array() as array<string>)"))
    got = correlate.related_issues(seeds, issues).collect()
    assert {r.n_related for r in got} == {300} and len(got) == 400
    ranks = correlate._ranked(seeds, issues.select(F.explode(F.split("title", " ")).alias("token")))
    sets = correlate._classes(correlate._token_sets(seeds.withColumn("n_run", F.lit(3)), ["run_id"], ranks, "n_run"), "n_run")
    assert sets.select("set").distinct().count() == 5


def test_alerts_across_midnight_two_platforms_and_late_lines(spark, tmp_path):
    import os

    source = tmp_path / "in"
    source.mkdir()
    batches = [
        [("r", "local", 1, "2024-01-01 23:50:00", "ERROR disk full"), ("r", "dbt", 2, "2024-01-01 23:51:00", "ERROR disk full")],
        [("r", "local", 3, "2024-01-02 00:05:00", "ERROR disk full"), ("q", "local", 4, "2024-01-02 00:06:00", "ERROR disk full"),
         ("r", "local", 5, "2024-01-02 00:07:00", "INFO disk full")],
        [("r", "local", 6, "2024-01-05 12:00:00", "ERROR other")],
        [("r", "local", 9, "2024-01-05 12:30:00", "ERROR other")],  # a watermark holds for late lines from the batch after next on
        [("late", "local", 7, "2024-01-02 01:00:00", "ERROR disk full"), ("r", "local", 8, "2024-01-05 13:00:00", "ERROR disk full")],
    ]
    schema = "run_id string, platform string, seq long, ts timestamp, line string"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "run_id string, platform string, seq long, t string, line string").selectExpr(
            "run_id", "platform", "seq", "cast(t as timestamp) as ts", "line")
        df.toPandas().to_parquet(source / f"f{i}.parquet", coerce_timestamps="us")
        os.utime(source / f"f{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = watch.drain(watch.watch_dedup(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    # one alert a platform and run although the day changed; again once the bound has passed; the late line raises none
    assert sorted(r.seq for r in out.collect()) == [1, 2, 4, 6, 8]


def test_every_window_is_emitted_at_the_end(spark, tmp_path):
    source = tmp_path / "in"
    lines = spark.range(120).select(
        F.lit("r").alias("run_id"), F.when(F.col("id") % 2 == 0, "local").otherwise("dbt").alias("platform"), F.col("id").alias("seq"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.concat(F.lit("ERROR connection timed out after "), F.col("id")).alias("line"))
    lines.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(lines.schema).parquet(str(source))
    out = watch.drain_closed(lambda s: watch.watch_category_counts(s, "10 minutes", "10 minutes"), stream,
                             str(tmp_path / "counts"), "10 minutes", "10 minutes")
    assert [r.failures for r in out.orderBy("window_start").collect()] == [10] * 12
    out = watch.drain_closed(lambda s: watch.watch_error_counts(s, "1 hour", "10 minutes"), stream,
                             str(tmp_path / "errors"), "1 hour", "10 minutes")
    assert sorted((r.platform, r.seq, r.n_events) for r in out.collect()) == [
        ("dbt", 1, 30), ("dbt", 61, 30), ("local", 0, 30), ("local", 60, 30)]
    empty = watch.drain_closed(lambda s: watch.watch_error_counts(s, "1 hour", "10 minutes"), stream.filter("seq < 0"),
                               str(tmp_path / "none"), "1 hour", "10 minutes")
    assert empty.count() == 0


def test_log_files_blank_missing_and_shared_baselines(spark, tmp_path):
    import json

    folder = tmp_path / "logs"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.log").write_text("INFO x\nERROR disk full\n")
    (folder / "b.log").write_text("ERROR disk full\n")
    (folder / "blank.log").write_text(" \n\n")
    (folder / "sub" / "c.log").write_text("ERROR other\n")
    (tmp_path / "base").mkdir()
    (tmp_path / "base" / "good.log").write_text("ERROR disk full\n")
    (folder / "a.meta.json").write_text(json.dumps({"baseline": "../base/good.log", "parameters": {"p": "1"}, "pipeline": "A"}))
    (folder / "b.meta.json").write_text(json.dumps({"baseline": "../base/good.log", "parameters": {"p": "2"}, "dependencies": {"lib": "1"}}))
    (folder / "sub" / "meta.json").write_text(json.dumps({"baseline": "missing.log"}))
    runs, events, configs = logs.scan_logs(
        spark, [str(folder)], [str(folder / "*.json"), str(folder / "sub" / "*.json")], [str(tmp_path / "base")])
    rows = {r.run_id.rsplit("/", 1)[-1]: r for r in runs.filter("run_id like '%.log'").collect()}
    assert set(rows) == {"a.log", "b.log", "blank.log", "c.log", "good.log"}
    assert rows["c.log"].baseline_id is None and rows["blank.log"].status == "failed"
    assert rows["a.log"].baseline_id == rows["b.log"].baseline_id == rows["good.log"].run_id
    assert rows["good.log"].status == "success" and rows["good.log"].parameters is None
    pairs = compare.baseline_link(runs)
    assert pairs.count() == 2
    # the sidecar describes both runs of a pair: only the logs can differ
    assert compare.diff_records(compare.run_entries(runs, configs), pairs).count() == 0
    assert compare.new_errors(events, pairs).count() == 0
    scanned = logs.scan_files(spark, str(folder))
    blank = [(r.seq, r.line) for r in scanned.filter("path like '%blank.log'").collect()]
    assert blank == [(None, None)]
    joined_without_pairs(scanned)
    joined_without_pairs(runs)


def test_equal_ids_of_two_platforms_get_their_own_incidents(spark):
    from faultline.plans import reports
    from faultline.sources import registry

    def source(platform, message, **more):
        runs = spark.createDataFrame([("7", platform, f"{platform} pipeline", "failed")], "run_id string, platform string, pipeline string, status string")
        events = spark.createDataFrame([("7", platform, 0, "error", message)], "run_id string, platform string, seq long, severity string, message string")
        return registry.Source(runs, events.withColumn("redacted", F.lit(False)), **more)

    issues = spark.createDataFrame([(0, "I1", "disk full on node", ["x"], "u")], "ord long, key string, title string, labels array<string>, url string")
    changes = spark.createDataFrame(
        [(0, "c1", "github", "commit", "rename customer_region", "2024", None, None)],
        "ord long, id string, platform string, kind string, title string, timestamp string, author string, summary string").withColumn(
        "source_ref", F.expr("named_struct('platform', 'github', 'native_id', 'c1', 'url', 'http://x', 'locator', cast(null as map<string,string>))"))
    result = registry.investigate_sources(
        source("local", "KeyError: 'customer_region'"), source("dbt", "disk full on node"),
        registry.Source(issues=issues), registry.Source(changes=changes)).staged()
    rows = {r.platform: r for r in result.incidents().collect()}
    assert set(rows) == {"local", "dbt"} and rows["local"].incident_key != rows["dbt"].incident_key
    assert rows["local"].token == "customer_region" and rows["dbt"].token is None and rows["dbt"].related_issues == 1
    evidence = {(r.platform, r.kind): r for r in result.evidence().collect() if r.kind == "strong_correlation" or r.source_ref}
    assert evidence[("local", "strong_correlation")].source_ref.url == "http://x"
    assert evidence[("dbt", "inference")].source_ref.native_id == "I1"
    stream = reports.result_datasets(result)["errors"].collect()
    assert {(r.platform, r.line) for r in stream} == {("local", "[0] KeyError: 'customer_region'"), ("dbt", "[0] disk full on node")}


def test_uncut_lists(spark):
    from faultline.plans import investigate as inv
    from faultline.plans import reports

    keys = [f"k{i:02d}" for i in range(30)]
    runs = spark.createDataFrame(
        [("f", "local", "P", "failed", "b", {k: "1" for k in keys}), ("b", "local", "P", "success", None, {k: "2" for k in keys})],
        "run_id string, platform string, pipeline string, status string, baseline_id string, parameters map<string,string>"
    ).withColumn("failed_stage", F.lit(None).cast("string")).withColumn("started_at", F.lit("2024"))
    log = events(spark, [("f", "local", i, "error", f"odd {chr(97 + i)} thing") for i in range(14)])
    issues = spark.createDataFrame([(i, f"I{i}", "odd thing", [], "u") for i in range(9)], "ord long, key string, title string, labels array<string>, url string")
    result = inv.investigate(runs, log, issues=issues).staged()
    cut, all_rows = result.evidence(), result.evidence(None, None, None, None)

    def count(rows, start):
        return rows.filter(F.col("statement").startswith(start) & (F.col("run_id") == "f")).count()

    assert (count(cut, "Parameter"), count(all_rows, "Parameter")) == (5, 30)
    assert (count(cut, "Similar"), count(all_rows, "Similar")) == (3, 9)
    new = spark.createDataFrame([("f", i, f"m{i}") for i in range(14)], "run_id string, seq long, message string")
    diff = spark.createDataFrame([], "run_id string, section string, key string, before string, after string")
    assert reports.diff_report_rows(diff, new).count() == 10 and reports.diff_report_rows(diff, new, limit=None).count() == 14


def test_short_id_of_an_empty_text(spark):
    from faultline.functions.text import short_id

    h = 2166136261
    digits = ""
    while h:
        digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
    assert spark.range(1).select(short_id("cast('' as string)").alias("x")).first().x == digits.rjust(7, "0")[:7]
