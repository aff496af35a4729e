"""Sides of a join whose size the planner can't see are never sent through the driver."""

from __future__ import annotations

import gzip
import random
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from faultline.operators import correlate
from faultline.storage import materialize


def exploded_broadcasts(df) -> list[str]:
    """Broadcasts that hold exploded rows, or a written file, with no shuffle before them to measure them."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        depth = line.index("BroadcastExchange")
        for below in lines[i + 1:]:
            at = len(below) - len(below.lstrip(" :+-*(0123456789)"))
            if at <= depth or "Exchange" in below:
                break
            if "Generate explode" in below:
                found.append(line.strip())
    return found


def changes_of(spark, n):
    out = spark.range(n).select(
        F.col("id").cast("int").alias("ord"), F.concat(F.lit("c"), "id").alias("id"), F.lit("commit").alias("kind"),
        F.concat(F.lit("RENAME COLUMN col_"), "id").alias("title"), F.lit("some words").alias("summary"),
        F.lit("2024-01-02").alias("timestamp"))
    return materialize(out, "changes")


def tokens_of(spark, n):
    out = spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("run_id"), F.concat(F.lit("col_"), "id").alias("token"),
        F.lit("2024-01-03").alias("started_at"))
    return materialize(out, "tokens")


@pytest.mark.parametrize("few", [0, 50_000])
def test_first_change_sends_no_index_through_the_driver(spark, monkeypatch, few):
    if hasattr(correlate, "FEW_LEADS"):
        monkeypatch.setattr(correlate, "FEW_LEADS", few)
    out = correlate.change_correlate(tokens_of(spark, 2_000), changes_of(spark, 300))
    assert exploded_broadcasts(out) == []
    # col_1 stands in col_1, col_10 to col_19, col_100 ...: the first is its own
    assert {r.run_id: r.change_id for r in out.collect()} == {f"r{i}": f"c{i}" for i in range(300)}


def seeds_and_issues(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(30)]
    seeds = spark.createDataFrame(
        [(f"r{i}", w) for i in range(30) for w in sorted(set(rng.sample(words, 5)))], "run_id string, token string")
    issues = spark.createDataFrame(
        [(i, f"K{i}", " ".join(rng.sample(words, 5)), ["label"]) for i in range(60)],
        "ord long, key string, title string, labels array<string>")
    return materialize(seeds, "seeds"), materialize(issues, "issues")


def test_issue_search_sends_no_tokens_through_the_driver(spark):
    seeds, issues = seeds_and_issues(spark)
    pairs = correlate.similar_incidents(seeds, issues)
    assert exploded_broadcasts(pairs) == []
    ranks = correlate._ranked(seeds, issues.select(F.col("key").alias("issue_key"), F.explode(F.split("title", " ")).alias("token")))
    members = issues.select("key", F.lit(5).alias("n"), F.explode(F.split("title", " ")).alias("token"))
    assert exploded_broadcasts(correlate._token_sets(members, ["key"], ranks, "n")) == []
    assert {r.run_id: r.n_related for r in correlate.related_issues(seeds, issues).collect()} == {
        r.run_id: r.n for r in pairs.groupBy("run_id").agg(F.count("*").alias("n")).collect()}


def test_watch_dedup_keeps_the_days_of_an_alert(spark, tmp_path):
    from faultline.catalog.spark_queries import QUERIES

    at = [datetime(2024, 1, 2, 8), datetime(2024, 1, 2, 9), datetime(2024, 1, 3, 8)]
    pq.write_table(pa.table({
        "event_id": pa.array([1, 2, 3], pa.int64()), "user_id": pa.array([7] * 3, pa.int64()), "event_type": ["view"] * 3,
        "ts": pa.array(at, pa.timestamp("us")), "props": ['{"k": 13}'] * 3}), tmp_path / "events.parquet")
    out = QUERIES["watch_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.day, r.run_id, r.severity, r.seq, r.n_events) for r in out) == [
        ("2024-01-02", "7-w0", "error", 1, 2), ("2024-01-03", "7-w0", "error", 3, 1)]


def test_log_files_are_opened_once(spark, tmp_path):
    from faultline.sources import logs

    for name, text in {"a": "x\n\ny \n", "b": " \n"}.items():
        (tmp_path / f"{name}.log").write_text(text)
    lines = logs.read_log_lines(spark, str(tmp_path))
    assert "text" not in {line.split("Format: ")[1].split(",")[0].lower() for line in
                          lines._jdf.queryExecution().executedPlan().toString().splitlines() if "Format: " in line}
    got = sorted((r.path[-5:], r.seq, r.line) for r in logs.scan_files(spark, str(tmp_path)).collect())
    assert [(p, line) for p, _, line in got] == [("a.log", "x"), ("a.log", "y"), ("b.log", None)]


def test_small_log_files_read_whole_give_the_lines_of_the_text_reader(spark, tmp_path, monkeypatch):
    from faultline.sources import logs

    for name, content in {
        "mark.log": b"\xef\xbb\xbffirst \r\n\n\xff\xfe no utf-8 \xa0\n \xe2\x82\xac tail", "blank.log": b" \n\t\n",
        "run=1/part.txt": "ä  \n b\x0b\x0c\nc\rd\r\n".encode(), "run=1/z.gz": gzip.compress(b"zip\nped\n"),
        "run=2/other.dat": b"x\n\ny"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    paths = [str(tmp_path / "*.log"), str(tmp_path / "run=*")]

    def got(read):
        return sorted((r.path.rsplit("/", 1)[1], -1 if r.seq is None else r.seq, r.line) for r in read(spark, paths).selectExpr(
            "path", "seq", "hex(cast(line as binary)) as line").collect())

    whole = got(logs.read_log_lines), got(logs.scan_files)
    assert [x[:2] for x in whole[1]] == [("blank.log", -1), ("mark.log", 0), ("mark.log", 1), ("mark.log", 2), ("other.dat", 0),
                                         ("other.dat", 1), ("part.txt", 0), ("part.txt", 1), ("part.txt", 2), ("z.gz", 0), ("z.gz", 1)]
    monkeypatch.setattr(logs, "WHOLE_BYTES", -1)
    assert (got(logs.read_log_lines), got(logs.scan_files)) == whole


def test_log_files_are_dealt_over_folders_and_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    """Many files: no folder holds them all, and Spark's default of a task for a few folders or files is not used."""
    from faultline.catalog import adapters
    from faultline.catalog.spark_queries import QUERIES

    n = 600
    pq.write_table(pa.table({
        "event_id": pa.array(range(2 * n), pa.int64()), "user_id": pa.array([None if i == 5 else i % n for i in range(2 * n)], pa.int64()),
        "event_type": ["view"] * 2 * n, "ts": pa.array([datetime(2024, 1, 2)] * 2 * n, pa.timestamp("us")),
        "props": ['{"k": 13}'] * 2 * n}), tmp_path / "events.parquet")
    monkeypatch.setattr(adapters, "FILES_A_FOLDER", 200)
    sc = spark.sparkContext
    status = sc.statusTracker()
    before = set(status.getJobIdsForGroup(None))
    got = QUERIES["log_files_scan"](spark, str(tmp_path)).collect()
    assert len({r.run_id for r in got}) == n + 1 and sum(r.seq is None for r in got) == n // 10
    assert sum(r.seq is not None for r in got) == 2 * (n - n // 10)
    assert [(r.seq, r.line) for r in got if r.run_id == "__HIVE_DEFAULT_PARTITION__"][0][0] == 0
    folders = adapters.write_log_files(spark, str(tmp_path), str(tmp_path / "out"))
    assert len(folders) >= 3
    tasks = [status.getStageInfo(s).numTasks for j in set(status.getJobIdsForGroup(None)) - before
             for s in status.getJobInfo(j).stageIds if status.getStageInfo(s)]
    assert tasks and max(tasks) <= 8 * sc.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


@pytest.mark.parametrize("few", [0, 1, 4, 1000])
@pytest.mark.parametrize("threshold", [0.05, 0.3])
def test_sets_that_differ_in_rare_tokens_are_compared_as_one(spark, monkeypatch, few, threshold):
    """Every issue has a number of its own and every run, too: their sets are all distinct, yet the pairs built are few."""
    monkeypatch.setattr(correlate, "FEW_ISSUES", few)
    monkeypatch.setattr(correlate, "CELL_RUNS", 7)
    monkeypatch.setattr(correlate, "CELL_ISSUES", 5)
    built = []
    monkeypatch.setattr(correlate, "materialize", lambda df, name, *a: built.append((name, materialize(df, name, *a))) or built[-1][1])
    rng = random.Random(11)
    words = [f"word{i}" for i in range(8)]
    runs = {f"r{i}": {"hot", f"n{100 + i}", f"n{101 + i}"} | set(rng.sample(words, rng.randint(0, 3))) for i in range(90)}
    runs["none"] = {"other"}
    issues = [(f"I{i % 75}", i % 80, {"hot", f"n{100 + i}"} | set(rng.sample(words, rng.randint(1, 3)))) for i in range(80)]
    seeds = spark.createDataFrame([(r, t) for r, ts in runs.items() for t in sorted(ts)], "run_id string, token string")
    table = spark.createDataFrame([(k, o, " ".join(sorted(t)), []) for k, o, t in issues], "key string, ord long, title string, labels array<string>")
    want = {}
    for r, a in runs.items():
        found = sorted((-len(a & b) / len(a | b), o, k) for k, o, b in issues if len(a & b) / len(a | b) >= threshold)
        if found:
            want[r] = len(found), [(i + 1, k, round(-s, 9)) for i, (s, _, k) in enumerate(found[:3])]
    got = correlate.related_issues(seeds, table, 3, threshold)
    assert exploded_broadcasts(got) == []
    assert {r.run_id: (r.n_related, [(x.rank, x.issue_key, round(x.similarity, 9)) for x in r.top]) for r in got.collect()} == want
    pairs = {name: df.count() for name, df in built if name.endswith("_pairs")}
    if few == 4:  # the numbers are rare, the words common
        assert pairs["set_pairs"] <= 3 * 80
        # the families of issues differ in words only
        assert dict(built)["issue_families"].count() < 80 and pairs["family_pairs"] < 0.8 * len(runs) * len(issues)


def test_grams_that_lead_no_token_are_not_shuffled(spark):
    tokens = spark.createDataFrame([(f"key_{i:05d}",) for i in range(0, 3000, 3)] + [("é",), ("z",)], "token string")
    changes = spark.createDataFrame([(i, f"some words of no token at all and key_{i:05d} ", "more words é" if i == 7 else None) for i in range(300)],
                                    "ord long, title string, summary string")
    needles = tokens.select(F.lower("token").alias("needle"))
    blocks = materialize(correlate.text_blocks(
        changes.select("ord", F.lower(F.concat("title", F.coalesce("summary", F.lit("")))).alias("text")), F.lit(9)), "blocks")
    leads = materialize(correlate._leads(needles), "leads")

    def wanted(few):
        found = correlate._pieces(blocks, leads, few).join(needles, "needle")
        return found, sorted((r.needle, r.ord) for r in found.collect())

    found, got = wanted(0)
    assert got == wanted(10**6)[1] == sorted([(f"key_{i:05d}", i) for i in range(0, 300, 3)] + [("é", 7)])
    assert exploded_broadcasts(found) == []
    index = correlate.gram_index(blocks)
    passed = index.filter(correlate._may_lead(leads, leads.count()))
    assert index.join(leads, "gram").count() == passed.join(leads, "gram").count()
    # 64 bits a lead: one gram in fifty passes by chance
    assert passed.count() - passed.join(leads, "gram").count() < index.count() / 40
