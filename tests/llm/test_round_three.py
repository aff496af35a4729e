"""Conversation trie, decontamination, whitening: against brute force, and edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import common, decontaminate, queries, trie, whitening
from tests.llm.test_text_operators import run


def test_list_digests_of_a_hot_key(spark):
    n = 3 * common.LIST_CHUNK + 7
    rows = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 7 - 50).alias("v")).union(
        spark.createDataFrame([("a", 10), ("a", 9), ("z", -1)], "k string, v long"))
    got = {r.k: (r.n, r.sha256) for r in run(common.list_digests, spark, rows, "k", "v").collect()}
    want = {"hot": [7 * i - 50 for i in range(n)], "a": [9, 10], "z": [-1]}
    assert got == {k: (len(v), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for k, v in want.items()}


def plain_trie(conversations, rebuild=True):
    """The contract, conversation by conversation, with Python tuples as nodes."""
    own = defaultdict(list)
    for conv, turn, role, text in conversations:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(rows)] for c, rows in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = tuple(turns.get(c - int(np.fmod(c, 100)), [])[:h] + mine[h:])
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, s in whole.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    out = []
    for node, held in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children[node]),
                    sum(not children[x] for x in below), saved,
                    hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string, depth string"


def test_trie_equals_brute_force(spark, sf):
    rng = np.random.default_rng(11)
    rows = []
    for c in [*range(0, 12), 100, 103, 150, 207, 208, -3, -250, 301]:
        for k in range(int(rng.integers(1, 7))):
            rows.append((c, k if k else None, "user" if k % 2 == 0 else None if c % 5 == 0 else "assistant", ["hi", "", None, "é\U0001f600", "ho"][int(rng.integers(0, 2 + 3 * (c % 2)))]))
    rows += [(5, 2, "user", "tie"), (5, 2, "user", "tie"), (5, 2, "a", "buser"), (None, 0, "user", "nobody's")]
    rows += [(400, i, "user", "long " * 20_000 if i == 3 else "x") for i in range(300)] + [(401, i, "user", "x") for i in range(2)]
    table = spark.createDataFrame([(*r, "extra") for r in rows], CONV)

    def rebuilt(t):
        return trie.graft(trie.numbered(t), F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % 6, 5)

    got = sorted((tuple(r) for r in run(lambda t: trie.nodes(trie.collapse(rebuilt(t))), spark, table).collect()), key=str)
    assert got == plain_trie(rows)
    assert run(lambda t: trie.nodes(trie.collapse(rebuilt(t))), spark, table.limit(0)).count() == 0
    # without grafts, the leaves are a corpus of their own
    few = table.filter("conv_id between 0 and 11")
    collapsed = run(lambda t: trie.collapse(trie.whole(trie.numbered(t))), spark, few)
    kept = trie.leaf_turns(few, collapsed)
    want = plain_trie([r for r in rows if r[0] is not None and 0 <= r[0] < 12], rebuild=False)
    assert collapsed.sequences.filter("leaf").count() == sum(r[4] == 0 for r in want)
    assert kept.select("conv_id").distinct().count() == sum(r[4] == 0 for r in want) and "depth" in kept.columns


def test_trie_of_equal_conversations(spark):
    rows = [(c, k, "user", "same" * (k + 1), None) for c in range(2_000) for k in range(2)]
    got = run(lambda t: trie.nodes(trie.collapse(trie.whole(trie.numbered(t)))), spark, spark.createDataFrame(rows, CONV)).collect()
    assert sorted((r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in got) == [
        (0, 2_000, 1, 1_999 * 12), (1, 2_000, 1, 1_999 * 12), (2, 2_000, 1, 1_999 * 8)]
    assert hashlib.sha256(",".join(map(str, range(2_000))).encode()).hexdigest() in {r.ends_sha256 for r in got}


def plain_hits(docs, items, window):
    def words(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    held = defaultdict(set)
    for name, text in items:
        w = words(text)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            held[tuple(w[a : a + k])].add(name or "")
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for g, who in held.items():
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    names |= who
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    pool = [f"w{i}" for i in range(12)] + ["É", "x1"]
    items = [(f"i{k}", " ".join(rng.choice(pool, int(rng.integers(1, 30))))) for k in range(25)]
    items += [("i3", "a a a a a a a a a a a a"), ("i9", "one"), ("i10", "Two words"), (None, "no NAME at all, but four"), ("empty", ""), ("null", None), ("i1", items[0][1])]
    docs = []
    for k in range(60):
        parts = [" ".join(rng.choice(pool, int(rng.integers(0, 90))))]
        if k % 3:
            parts.append(items[int(rng.integers(0, len(items)))][1] or "")
        docs.append((k, "; ".join(parts + [" ".join(rng.choice(pool, 4))]).upper()))
    docs += [(7, "a " * 40), (7, "a " * 40), (None, "One TWO-words"), (500, None), (501, ""), (502, " \n.;"), (503, "w1 " * 70_000 + (items[4][1] or ""))]
    d = spark.createDataFrame([(*r, 5, "x") for r in docs], "doc_id long, text string, uid int, key string")
    i = spark.createDataFrame([(*r, "z") for r in items], "item_id string, text string, words string")
    want = plain_hits([x for x in docs if x[0] != 503], items, 10)
    got = run(lambda a, b: decontaminate.find(a, b).report(), spark, d, i).collect()
    assert sorted((tuple(r) for r in got if r.doc_id != 503), key=str) == want
    long = next(r for r in got if r.doc_id == 503)
    assert long.n_words == 70_000 + len(items[4][1].split()) and long.contaminated
    assert run(lambda a, b: decontaminate.find(a, b).report(), spark, d.limit(0), i).count() == 0
    none = run(lambda a, b: decontaminate.find(a, b).report(), spark, d, i.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_items for r in none)


def test_decontamination_below_full_containment(spark):
    rng = np.random.default_rng(13)
    pool = [f"v{i}" for i in range(9)]
    items = [(f"i{k}", " ".join(rng.choice(pool, 12))) for k in range(8)]
    docs = []
    for k in range(40):
        w = items[k % 8][1].split()
        w[int(rng.integers(0, 12))] = "odd"
        docs.append((k, " ".join([*rng.choice(pool, int(rng.integers(0, 6))), *w, *rng.choice(pool, int(rng.integers(0, 6)))])))
    share, k, size = 0.5, 3, 10
    want = set()
    for doc, text in docs:
        w = text.split()
        for name, own in items:
            v = own.split()
            for a in range(len(v) - size + 1):
                wanted = {tuple(v[x : x + k]) for x in range(a, a + size - k + 1)}
                for b in range(len(w) - size + 1):
                    if len(wanted & {tuple(w[x : x + k]) for x in range(b, b + size - k + 1)}) >= share * len(wanted):
                        want.add((doc, b, " ".join(v[a : a + size])))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    found = run(lambda a, b: decontaminate.find(a, b, window=size, shingle=k, containment=share), spark, d, i)
    rows = found.spans.join(found.documents, "uid").join(found.windows.select("wid", "words").distinct(), "wid").collect()
    assert {(r.doc_id, r.begin, r.words) for r in rows} == want and len(rows) == len(want)


def test_bitmap_has_no_false_negatives():
    numbers = np.random.default_rng(14).integers(0, 1 << 63, 3_000, dtype=np.uint64) * np.uint64(2)
    bits, blocks = 20, {}
    for slot in (numbers >> np.uint64(44)).tolist():
        held = blocks.setdefault(slot >> 15, np.zeros(32_768, np.uint8))
        held[slot & 32_767] = 1
    known = decontaminate.Bitmap(bits, {b: np.packbits(m, bitorder="little").tobytes() for b, m in blocks.items()})
    other = np.random.default_rng(15).integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert known.has(numbers).all() and known.has(other).mean() < 0.01


@pytest.mark.parametrize("kind", ["plain", "equal", "rank", "graded", "split", "wide"])
def test_solver_equals_dense_eigenvectors(kind):
    rng = np.random.default_rng(16)
    a = rng.standard_normal((300, 40))
    if kind == "equal":
        a = np.linalg.qr(a)[0] * np.r_[np.full(12, 3.0), np.full(28, 1.0)]
    elif kind == "rank":
        a = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 40))
    elif kind == "graded":
        a *= 10.0 ** -np.arange(40).clip(0, 9)
    elif kind == "split":
        a = np.diag(np.r_[np.zeros(3), np.arange(1.0, 38.0)])
    elif kind == "wide":
        a = rng.standard_normal((9, 40))
    r = np.linalg.qr(a, mode="r")
    r = np.concatenate([r, np.zeros((40 - len(r), 40))])
    d, u, v = whitening.bidiagonal(r)
    assert np.abs(v.T @ v - np.eye(40)).max() < 1e-13
    want = np.linalg.svd(r, compute_uv=False) ** 2
    got = whitening.qd_values(d, u)
    assert got == pytest.approx(want, rel=1e-12, abs=want[0] * 1e-26 if kind in ("plain", "equal") else want[0] * 1e-14)
    values, vectors = whitening.directions(r, 8)
    assert len(values) == (5 if kind == "rank" else 8)
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_dqds_keeps_small_values_accurate():
    q, e = np.array([1.0, 1e-3, 1e-6, 1e-9, 1e-12]), np.array([1.0, 1e-2, 1e-5, 1e-8])
    got = whitening.qd_values(q, e)
    from fractions import Fraction  # the determinant of B^T B is the product of the squared diagonal

    want = Fraction(1)
    for x in q:
        want *= Fraction(float(x)) ** 2
    product = Fraction(1)
    for x in got:
        product *= Fraction(float(x))
    assert abs(float(product / want) - 1) < 1e-12


def test_whitening_equals_dense_covariance(spark):
    rng = np.random.default_rng(17)
    raw = (rng.standard_normal((700, 24)) * np.linspace(0.2, 1.5, 24)).astype(np.float32)
    rows = [(k, [float(x) for x in v], "x") for k, v in enumerate(raw)] + [(3, [float(x) for x in raw[3]], "x"), (None, [0.5] * 10, None)]
    bad = [(900, None, "n"), (901, [1.0, None] * 12, "n"), (902, [float("nan")] * 24, "n"), (903, [float("inf")] * 24, "n")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, component string").repartition(7)
    got = run(whitening.whiten, spark, table, 8).collect()
    assert len(got) == 8 * len(rows)
    padded = np.zeros((len(rows), 24))
    for k, (_, v, _) in enumerate(rows):
        padded[k, : len(v)] = np.array(v, np.float32)
    x = np.floor(1024 * padded).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:8]
    want = c @ vectors[:, order] / np.sqrt(values[order])
    far = {(rows[k][0], int(((n * x[k] - s) ** 2).sum())) for k in range(n)}
    assert {(r.vec_id, r.deviation) for r in got} == far and {r.n for r in got} == {n}
    for comp in range(1, 9):
        own = {r.vec_id: r.whitened for r in got if r.component == comp}
        theirs = {rows[k][0]: want[k, comp - 1] for k in range(n)}
        sign = np.sign(own[0] * theirs[0])
        assert max(abs(own[k] - sign * theirs[k]) for k in own) < 1e-9
        share = next(r.explained for r in got if r.component == comp)
        assert share == pytest.approx(values[order[comp - 1]] / values.sum(), rel=1e-9)
    assert got[0].identity_error < 1e-9
    # triangles folded in a tree give the same directions
    fine = run(lambda t: whitening.fit(t, 8, fan=2), spark, table)
    assert np.abs(np.abs((fine.vectors * vectors[:, order]).sum(0)) - 1).max() < 1e-9


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert run(whitening.whiten, spark, spark.createDataFrame(rows, kind)).count() == 0
    two = run(whitening.whiten, spark, spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.5, 0.0])], kind)).collect()
    assert sorted(round(abs(r.whitened), 9) for r in two) == [1.0, 1.0] and {r.component for r in two} == {1}
    huge = run(whitening.whiten, spark, spark.createDataFrame([(1, [3e38, 0.0]), (2, [0.0, 0.25]), (3, [0.0, 0.0])], kind)).collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None} and len(huge) >= 3


def test_new_queries_on_the_smallest_tables(spark, sf):
    rows = queries.QUERIES["op13_whitening"](spark, sf).collect()
    assert len(rows) == 8 * 500 and rows[0].identity_error < 1e-6
    conv = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = sorted((tuple(r) for r in queries.QUERIES["op11_conversation_trie"](spark, sf).collect()), key=str)
    assert got == plain_trie([tuple(r) for r in conv])
