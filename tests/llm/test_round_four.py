"""The perplexity model beyond what every task holds."""

import zlib

import pytest

from faultline.llm import perplexity

from .test_text_operators import PlainKneserNey, prose  # noqa: F401


def test_perplexity_of_five_bytes_over_many_parts(spark, prose, monkeypatch):
    monkeypatch.setattr(perplexity, "PART_BYTES", 3_000)
    monkeypatch.setattr(perplexity, "MIN_PARTS", 5)
    monkeypatch.setattr(perplexity, "SMALL_PART", 1_000)
    monkeypatch.setattr(perplexity, "ROWS", 2)
    docs = spark.createDataFrame(prose, "doc_id long, text string, lang string, source string, n_chars int")
    rows = {r.doc_id: r for r in perplexity.judge_quality(docs).collect()}
    assert len(rows) == len(prose)
    for lang in ("aa", "bb"):
        plain = [PlainKneserNey([d[1] for d in prose if d[2] == lang and zlib.crc32(d[1].encode()) % 2 == k], 5) for k in (0, 1)]
        for d in prose[:20]:
            if d[2] == lang:
                judge = plain[1 - zlib.crc32(d[1].encode()) % 2]
                assert rows[d[0]].log_perplexity == pytest.approx(judge.log_perplexity(d[1]), abs=1e-9)


def test_perplexity_documents_travel_packed(spark):
    words = "the order of a line was read from this table and written to one part of that store again".split()
    docs = [(i if i % 9 else None, ("aa", "", "bb")[i % 3], " ".join(words[(i * k) % 19] for k in range(150)) if i % 7 else None) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    packed = perplexity.pack_documents(frame, 3).toArrow()
    order = lambda row: (str(row[0]), row[1], row[2] or "")
    got = [tuple(r.values()) for r in perplexity.unpack_documents(packed).to_pylist()]
    assert sorted(got, key=order) == sorted(docs, key=order)
    assert set(packed["part"].to_pylist()) == {0, 1, 2}
    assert sum(map(len, packed["docs"].to_pylist())) < 0.4 * sum(len(d[2] or "") for d in docs)


def test_perplexity_shuffles_no_plain_texts(spark, prose):  # noqa: F811
    docs = spark.createDataFrame(prose, "doc_id long, text string, lang string, source string, n_chars int").select("doc_id", "lang", "text")
    counted = perplexity.count_ngrams(docs)
    plan = perplexity.score(docs, counted, perplexity.train(counted))._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.split("\n") if "FlatMapGroupsInArrow" in line or "FlatMapCoGroupsInArrow" in line]
    assert len(groups) == 3 and not any("text" in line for line in groups)


def test_components_release_what_a_round_held(spark, monkeypatch):
    from faultline.llm import components as module

    released = []
    monkeypatch.setattr(module, "release", released.append)
    links = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    assert {(r.id, r.root) for r in module.components(links).collect()} == {(k, 0) for k in range(21)}
    assert len(released) >= 2  # once a round


def test_near_duplicates_write_few_files(spark):
    import glob

    from faultline.llm import minhash
    from faultline.storage import shared_dir

    def near(k, lost):
        return " ".join(f"{k % 6}w{i}" for i in range(60) if i != lost)

    # Links in a chain, so that there are rounds, and buckets of two components.
    docs = spark.createDataFrame([(k, near(k, k // 6)) for k in range(240)] + [(240, ""), (241, None)], "doc_id long, text string")
    root = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/faultline/*"))
    held = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = minhash.near_duplicates(docs, 4, 80).collect()
    finally:
        for k in held:
            spark.conf.unset(k)
    assert {(r.doc_id, r.component_id) for r in rows} == {(k, k % 6) for k in range(240)} | {(240, 240), (241, 241)}
    made = {p: len(glob.glob(f"{p}/part-*")) for p in set(glob.glob(f"{root}/faultline/*")) - before}
    files = [n for p, n in made.items() if p.split("/")[-1].split("-")[0] in ("buckets", "pairs", "edges", "labels", "open")]
    assert len(files) >= 5 and max(files) <= max(6, spark.sparkContext.defaultParallelism)
