"""Near-duplicates of texts and vectors, line dedup, components: against brute force, and edge cases."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import components, linededup, minhash, rpforest
from tests.llm.test_text_operators import run


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components_of_long_and_mixed_graphs(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(100, 140)] + [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(40)]
    want = groups({x for pair in links for x in pair if pair[0] != pair[1]}, links)
    got = {r.id: r.root for r in run(components.components, spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def near_texts():
    rng = np.random.default_rng(4)
    docs = []
    for base in range(6):
        words = [f"w{base}x{i}" for i in range(120)]
        for copy in range(30 if base == 0 else 5):
            own = list(words)
            for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
                own[at] = f"e{base}c{copy}p{at}"
            docs.append(" ".join(own))
    return docs


def test_minhash_groups_equal_brute_force(spark):
    texts = near_texts() + ["Short text", "short TEXT", "one", None, "", " \n", None]
    rows = [(1_000 - i, t, "x") for i, t in enumerate(texts)] + [(None, "only here and nowhere else at all", "x"), (7, "rep eat ed row", "x"), (7, "rep eat ed row", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    links = [(a, b) for a, b in combinations([i for i in sets if i is not None], 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups([i for i in sets if i is not None], links)
    got = run(minhash.near_duplicates, spark, docs, 4, 80).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want | {None: None}
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got)
    kept = run(minhash.drop_near_duplicates, spark, docs, 4, 80)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i for i in want.values()} | {None})
    assert run(minhash.drop_near_duplicates, spark, docs.limit(0)).count() == 0


def test_shared_cell_bound_never_excludes_a_link():
    sets = minhash.shingle_sets(near_texts(), 4)
    for a, b in combinations(range(0, len(sets), 3), 2):
        cells = [np.bincount((s % np.uint64(minhash.CELLS)).astype(int), minlength=minhash.CELLS) for s in (sets[a], sets[b])]
        assert np.minimum(*cells).sum() >= len(np.intersect1d(sets[a], sets[b]))


def test_forest_links_and_groups(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 32))
    near = np.repeat(base[:3], 60, 0) + rng.standard_normal((180, 32)) * 0.22
    v = np.concatenate([base, near, base[:20] * 2.5])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [1.0, None] + [0.0] * 30), (904, [float("nan")] * 32),
           (905, [float("inf")] + [1.0] * 31), (906, [1e-160] + [0.0] * 31), (907, [1e160]), (None, [0.0, 5.0])]
    table = spark.createDataFrame([(i, r, 0) for i, r in rows + odd], "vec_id long, embedding array<double>, leaf int")
    got = {r.vec_id: r for r in run(rpforest.near_duplicates, spark, table, 0.9, 8, 60, 500, 64).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    n = np.bincount(np.concatenate([a, b]), minlength=len(v))
    found = np.array([got[i].n_links for i in range(len(v))])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    want = groups(range(len(v)), zip(a.tolist(), b.tolist()))
    assert np.mean([got[i].component_id == want[i] for i in range(len(v))]) > 0.97
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905))
    assert got[907].component_id == 906 and got[906].n_links == 1  # padded with zeros; huge and tiny numbers
    assert run(rpforest.near_duplicates, spark, table.limit(0)).count() == 0


def near_vectors(n, dim, seed):
    """Unlike vectors, clusters at a cosine of about 0.9 and one group with a third of all rows."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    v[n // 2 : n // 2 + n // 10] = np.repeat(v[: n // 50], 5, 0)[: n // 10] + rng.standard_normal((n // 10, dim)) * 0.3
    v[-(n // 3) :] = v[0] + rng.standard_normal((n // 3, dim)) * 0.3
    return v


def test_forest_grows_beyond_its_sample(spark):
    """A sample that could split only twice: subtrees of the open leaves go on, and no leaf is left to grow with the table."""
    n, leaf = 2_000, 80
    v = near_vectors(n, 24, 11)
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    first = rpforest.Forest(unit[:: n // 64][:64], n, 0.9, 8, leaf)
    assert first.open and max(np.bincount(np.concatenate(first.route(unit)))) > 2 * leaf
    levels = []
    deepen = rpforest._deepen

    def watched(*args):
        levels.append(deepen(*args))
        return levels[-1]

    rpforest._deepen = watched
    try:
        got = {r.vec_id: r for r in run(rpforest.near_duplicates, spark, table, 0.9, 4, leaf, 64, 1_024, 300).collect()}
    finally:
        rpforest._deepen = deepen
    assert len(levels) > 1 and levels[-1] is None
    open_left = levels[-2][1].filter("open").groupBy("leaf").count().agg(F.max("count")).first()[0]
    assert (open_left or 0) <= 2 * leaf
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.9 * links.sum()
    want = np.arange(n)
    while True:  # smallest id along links
        reach = np.minimum(want, np.where(links, want[None, :], n).min(1))
        if (reach == want).all():
            break
        want = reach
    assert np.mean([got[i].component_id == want[i] for i in range(n)]) > 0.9


def plain_line_dedup(docs, min_texts):
    """(doc, line) pairs to drop, by the definitions, on real tokens."""
    distinct, texts = {}, defaultdict(set)
    for doc, text in docs:
        for k, line in enumerate((text or "").split("\n")) if text is not None else ():
            tokens = tuple(linededup.masked(line))
            if len(tokens) >= linededup.MIN_TOKENS:
                distinct.setdefault(tokens, []).append((doc, k, text))
                texts[tokens].add(text)
    leaves = defaultdict(list)
    for tokens in distinct:
        leaves[len(tokens), tokens[: linededup.LEAD]].append(tokens)
    drop = set()
    for lines in leaves.values():
        import xxhash
        hashed = lambda t: np.uint64(xxhash.xxh3_64_intdigest(" ".join(t))).astype(np.int64)
        lines.sort(key=lambda t: (-len(texts[t]), hashed(t)))
        templates = []
        for t in lines:
            best = max(templates, key=lambda m: sum(x == y for x, y in zip(m[0], t)), default=None)
            if best and sum(x == y for x, y in zip(best[0], t)) >= linededup.SIMILARITY * len(t):
                best[0] = [x if x == y else None for x, y in zip(best[0], t)]
                best[1].append(t)
            else:
                templates.append([list(t), [t]])
        for _, own in templates:
            seen = sorted((place for t in own for place in distinct[t]), key=lambda p: p[:2])
            if len({p[2] for p in seen}) >= min_texts:
                drop |= {p[:2] for p in seen if p[:2] != seen[0][:2]}
    return drop


def test_line_dedup_equals_the_plain_version(spark):
    rng = np.random.default_rng(6)
    docs = []
    for i in range(24):
        lines = [" ".join(f"t{rng.integers(0, 400)}q" for _ in range(9)) for _ in range(4)]
        lines.insert(1, f"Page {i} of the long report made by user {chr(97 + i)}")
        if i % 3 == 0:
            lines.append("All rights reserved here")
        docs.append((i, "\n".join(lines + ["", "ok"])))
    docs += [(50, docs[0][1]), (51, None), (52, ""), (None, docs[1][1])]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, template string")
    rows = run(linededup.drop_recurring_lines, spark, table).collect()
    drop = plain_line_dedup([(i if i is not None else 2**63 - 1, t) for i, t in docs], linededup.MIN_TEXTS)
    assert len(rows) == len(docs)
    for r in rows:
        i, text = r.row.doc_id, r.row.text
        key = i if i is not None else 2**63 - 1
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (key, k) not in drop)
        assert r.text == want and r.row.template == "x"
        assert r.n_lines == (0 if text is None else len(text.split("\n")))
    assert sum(r.n_dropped for r in rows) == len(drop) > 20
    assert run(linededup.drop_recurring_lines, spark, table.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.6, 0.9])
def test_leaf_fold_keeps_unlike_lines_apart(share):
    pack = lambda *n: np.array(n, "<u2").tobytes()
    lines = np.array([5, 6, 7])
    got = linededup.fold_leaf(lines, [pack(1, 2, 3, 4, 5), pack(1, 2, 3, 4, 9), pack(1, 8, 8, 8, 8)], share)
    assert got.tolist() == ([5, 5, 7] if share == 0.6 else [5, 6, 7])


def test_minhash_many_null_and_equal_ids(spark):
    """5,000 texts without an id, and 5,000 with one: as with ids of their own, in like time."""
    import time

    def docs(ids):
        return spark.range(5_000).select(ids.alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.floor(F.col("id") / 5)) for k in range(12)]).alias("text"))

    def timed(frame):
        start = time.time()
        rows = run(minhash.near_duplicates, spark, frame, 4, 80).collect()
        return time.time() - start, rows

    base, rows = timed(docs(F.col("id")))
    assert sum(r.kept for r in rows) == 1_000
    for ids in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        took, rows = timed(docs(ids))
        assert len(rows) == 5_000 and sum(r.stays for r in rows) == 1_000 and took < 3 * base + 10
    assert run(minhash.drop_near_duplicates, spark, docs(F.lit(None).cast("long")), 4, 80).count() == 1_000
    odd = spark.createDataFrame([(-(1 << 63), "a b c d e f"), (None, "q r s t u v"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in run(minhash.drop_near_duplicates, spark, odd, 4, 80).collect()) == ["-9223372036854775808", "None"]
