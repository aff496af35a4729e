"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    chat,
    decontaminate,
    langid,
    linededup,
    minhash,
    mixing,
    packing,
    perplexity,
    rpforest,
    toxicity,
    trie,
    urltrust,
    whitening,
)
from faultline.llm.common import folds, importable, table
from faultline.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = importable(fn)
    return fn


@query
def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return urltrust.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


ORACLE["op1_url_trust"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(v, h, f) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
j AS (
  SELECT p.*, (SELECT max_by(struct_pack(v := v, r := h || f), length(h || f)) FROM rules
    WHERE (p.host = h OR p.host LIKE '%.' || h) AND starts_with(p.path, f)) AS found
  FROM p),
l AS (
  SELECT host AS a, translate(regexp_extract(u, '//([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b
  FROM (SELECT host, unnest(regexp_extract_all(html,
    '(?i)href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"''\s>]*)', 1)) AS u FROM p)),
e AS (SELECT a, b, count(*) AS w FROM l WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
s AS (
  SELECT host, avg(CASE WHEN found.v = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS good,
    avg(CASE WHEN found.v = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS bad
  FROM j GROUP BY host),
h AS (
  SELECT host, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM s FULL JOIN (SELECT a AS host FROM e UNION SELECT b FROM e) USING (host)),
f AS (
  SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS fw, w / sum(w) OVER (PARTITION BY b) AS bw FROM e),
r AS (
  SELECT host, 0 AS i, 0.15 * good AS t, 0.15 * bad AS d FROM h
  UNION ALL
  SELECT h.host, r0.i + 1, 0.15 * h.good + 0.85 * coalesce(sum(CASE WHEN r0.host = f.a AND h.host = f.b THEN r0.t * f.fw END), 0),
    0.15 * h.bad + 0.85 * coalesce(sum(CASE WHEN r0.host = f.b AND h.host = f.a THEN r0.d * f.bw END), 0)
  FROM h CROSS JOIN r AS r0 LEFT JOIN f ON (r0.host = f.a AND h.host = f.b) OR (r0.host = f.b AND h.host = f.a)
  WHERE r0.i < 20 GROUP BY h.host, h.good, h.bad, r0.i)
SELECT page_id, j.host, path, found.r AS rule,
  coalesce(found.v, CASE WHEN d >= 0.02 AND d > t THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN r ON r.host = j.host AND i = 20
"""


@query
def op2_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, perplexity and verdict of every document."""
    return perplexity.judge_quality(table(spark, sf_dir, "documents"))


@query
def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings at a cosine of 0.9 or more."""
    return rpforest.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and digests read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"select -7L as conv_id, 0L as turn, 'user' as role, '{said}' as text "
                        f"union all select -7L, 1L, 'assistant', '{said}'")
    return chat.read_back(chat.format_conversations(turns.unionByName(planted)))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (folds("doc_id", 4) == 2).alias("held_out"))
    net = toxicity.train(docs.filter("not held_out"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, net)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("row.doc_id", "row.held_out", "score", predicted.alias("predicted"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", (folds("doc_id", 3) == 1).alias("held_out"))
    trees = langid.train(docs.filter("not held_out"))
    judged = langid.predict(docs.select("doc_id", "held_out", "text"), trees)
    return judged.select("row.doc_id", "row.held_out", "lang_pred", "score", "bits_per_byte")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.drop_recurring_lines(docs)
    return out.select("row.doc_id", "text", "n_lines", "n_dropped")


#: Shares of the domains in the mix.
MIX = {"good": 0.90, "low": 0.08, "toxic": 0.02}


@query
def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and copies of every document, so that expected domain tokens meet the target weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    domain = mixing.label_domain(F.col("quality"), F.col("toxic"))
    model = mixing.train(docs, table(spark, sf_dir, "labels"), domain, mixing.DOMAINS)
    out = mixing.mix(docs, model, MIX, keep=["doc_id"])
    return out.select("row.doc_id", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)],
                      "rate", "copies")


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in as few sequences of at most 2048 tokens as best fit finds."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), 2048), 2048)


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four-word shingles, similarity 0.8 or more."""
    groups = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE["op8_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g
  FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
  s.doc_id <= coalesce(m, s.doc_id) AS kept
FROM s LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = s.doc_id
"""


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    turns = materialize(trie.numbered(table(spark, sf_dir, "conversations")), "turns")
    keep = F.crc32(F.col("conv_id").cast("string")) % 6
    rebuilt = trie.graft(turns, F.col("conv_id") - F.col("conv_id") % 100, keep, most=5)
    return trie.nodes(trie.collapse(rebuilt))


ORACLE["op11_conversation_trie"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS b, xor(list_reduce(list_concat([4294967295],
      flatten([[ascii(d), -1, -1, -1, -1, -1, -1, -1, -1] FOR d IN string_split(CAST(conv_id AS VARCHAR), '')])),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
g AS (
  SELECT c.conv_id, pos, r, x FROM c JOIN t ON t.conv_id = c.b AND pos < h
  UNION ALL SELECT c.conv_id, pos, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
l AS (
  SELECT c.conv_id, coalesce(s, []) AS s, coalesce(n, []) AS n
  FROM c LEFT JOIN (SELECT conv_id, list(md5(strlen(r) || ':' || r || x) ORDER BY pos) AS s, list(length(x) ORDER BY pos) AS n
    FROM g GROUP BY conv_id) USING (conv_id)),
p AS (
  SELECT conv_id, array_to_string(s, '') AS whole, d, array_to_string(s[1:d], '') AS node,
    CASE WHEN d > 0 THEN array_to_string(s[1:d - 1], '') END AS parent, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS k
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM l)),
v AS (
  SELECT node, min(d) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(k) AS own,
    string_agg(CASE WHEN node = whole THEN conv_id END, ',' ORDER BY conv_id) AS ends
  FROM p GROUP BY node),
u AS (SELECT DISTINCT parent AS node FROM v WHERE parent IS NOT NULL),
sub AS (SELECT DISTINCT a.node AS top, b.node FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
  SELECT top, sum(own) AS saved, count(*) FILTER (WHERE u.node IS NULL) AS leaves
  FROM sub JOIN v USING (node) LEFT JOIN u USING (node) GROUP BY top),
ch AS (SELECT parent AS node, count(*) AS children FROM v WHERE parent IS NOT NULL GROUP BY parent)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, w.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(children, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN sums ON sums.top = v.node LEFT JOIN ch ON ch.node = v.node LEFT JOIN v AS w ON w.node = v.parent
"""


@query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of ten benchmark words, and the items they come from."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.report()


ORACLE["op12_decontamination"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
i AS (
  SELECT DISTINCT item, least(10, len(w)) AS k,
    array_to_string(w[a:a + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS a FROM b WHERE len(w) > 0)),
d AS (
  SELECT uid, a, k, array_to_string(w[a:a + k - 1], ' ') AS g
  FROM (SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM w CROSS JOIN (SELECT DISTINCT k FROM i))),
m AS (SELECT d.uid, d.a, d.k, i.item FROM d JOIN i ON d.g = i.g AND d.k = i.k),
h AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(a, a + k)) AS p FROM m) GROUP BY uid),
s AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item FROM m) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (uid) LEFT JOIN s USING (uid)
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)
