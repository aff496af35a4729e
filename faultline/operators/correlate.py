"""Correlate runs with change events and past issues.

Neither operator compares every run with every change or issue. Both go through
equality joins on text pieces, both are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, parsing
from ..functions.text import tokenize
from ..sources.model import run_key
from ..storage import drop_shuffles, materialize
from .skew import one_per_key, shuffled

#: Lengths of the leading gram by which a token is looked up, and how many tokens may share one
#: before the next length is used.
GRAMS = (3, 6, 12, 24)
HOT_GRAM = 16
#: Characters of a text that one row indexes.
BLOCK_CHARS = 256
#: Leading grams, 24 characters at most each, that are sent to every task; more of them are shuffled.
FEW_LEADS = 50_000
CELL_RUNS = 4096      # rows of one side that meet in one join cell of a hot token
CELL_ISSUES = 4096
FEW_ISSUES = 64       # issues that may hold a token for the pairs of sets that share it to be listed


# --- changes ----------------------------------------------------------------

def _leads(wanted: DataFrame) -> DataFrame:
    """gram, sizes: the leading gram of every needle, and the lengths of the needles behind it.

    A gram shared by more than HOT_GRAM needles (they all begin ``col_``, say) gives way to
    the next longer one that the needle has, so that a place in a text asks for few lengths.
    """
    length = F.length("needle")
    levels = F.filter(F.array(*[F.lit(n) for n in GRAMS]), lambda n: n <= F.greatest(length, F.lit(GRAMS[0])))
    grams = wanted.select("needle", F.explode(levels).alias("level")).withColumn(
        "gram", F.substring("needle", F.lit(1), F.col("level")))
    counts = one_per_key(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    chosen = grams.join(counts, "gram").groupBy("needle").agg(
        F.min(F.when(F.col("n") <= HOT_GRAM, F.col("level"))).alias("rare"), F.max("level").alias("last"))
    lead = F.substring("needle", F.lit(1), F.coalesce("rare", "last"))
    return chosen.select(lead.alias("gram"), length.alias("size")).groupBy("gram").agg(F.collect_set("size").alias("sizes"))


def text_blocks(texts: DataFrame, longest: Column) -> DataFrame:
    """ord, block, part, more: the texts in blocks of BLOCK_CHARS; ``more`` is the block and what follows it, ``longest`` characters at least.

    Cut in one pass over the text, so the work is linear in its length.
    """
    tail = F.ceil(longest / F.lit(BLOCK_CHARS)).cast("int")
    parts = texts.select("ord", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0)).alias("parts"))
    return parts.select("ord", tail.alias("tail"), "parts", F.posexplode("parts").alias("block", "part")).select(
        "ord", "block", "part",
        F.array_join(F.slice("parts", F.col("block") + 1, F.col("tail") + 1), "").alias("more"))


def gram_index(blocks: DataFrame) -> DataFrame:
    """ord, block, more, at, gram: a row for each place of a text and each gram length; short ones at every place too."""
    places = blocks.select("ord", "block", "more", F.explode(F.sequence(F.lit(1), F.length("part"))).alias("at"))
    sizes = F.array(*[F.lit(n) for n in (*range(1, GRAMS[0]), *GRAMS)])
    return places.select("ord", "block", "more", "at", F.explode(F.array_distinct(F.transform(
        sizes, lambda n: F.substring("more", F.col("at"), n)))).alias("gram"))


def _may_lead(leads: DataFrame, count: int) -> Column:
    """Whether ``gram`` can be one of ``leads``: a bitmap of their hashes, 64 bits a lead and 8 MB at most, as a scalar."""
    words = 1 << min(20, max(6, (count - 1).bit_length()))
    spot = F.pmod(F.xxhash64("gram"), F.lit(words * 64))
    word, bit = F.floor(spot / 64).cast("int"), (spot % 64).cast("int")
    marks = leads.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits"))
    empty = leads.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    whole = marks.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]))
    return F.call_function("shiftrightunsigned", F.get(whole.scalar(), word), bit).bitwiseAND(F.lit(1)) == 1


def _pieces(blocks: DataFrame, leads: DataFrame, few: int) -> DataFrame:
    """ord, needle: what the texts hold, in the sizes asked for, at each place that a gram of ``leads`` leads.

    The index has hundreds of rows for a row of ``blocks``, which the planner's size check does not
    see, so the sides are fixed here: up to ``few`` leads are sent to the index, more meet it in a
    sort-merge join, and the block is fetched again for the places found. Nearly all grams of the texts lead
    no token, and a bitmap drops them where they are made, so the index itself is never shuffled.
    """
    index, piece = gram_index(blocks), F.substring("more", F.col("at"), F.col("size")).alias("needle")
    count = leads.count()
    if count <= few:
        return index.join(F.broadcast(leads), "gram").select("ord", "more", "at", F.explode("sizes").alias("size")).select("ord", piece)
    led = index.drop("more").filter(_may_lead(leads, count)).join(shuffled(one_per_key(leads, "gram")), "gram").select(
        "ord", "block", "at", F.explode("sizes").alias("size")).distinct()
    return led.join(shuffled(blocks.select("ord", "block", "more")), ["ord", "block"]).select("ord", piece)


def first_change_per_token(tokens: DataFrame, changes: DataFrame) -> DataFrame:
    """(needle, ord): the first change whose text contains each distinct token.

    Substring search as equality joins over a positional gram index: a place in a text whose gram
    leads some token is looked up once, then the pieces that such tokens would have to equal are read
    from its block. Pieces are folded to their lowest ``ord`` before the last join, so it is one row against
    one row and a gram shared by all tokens and all changes does not multiply them.
    """
    wanted = tokens.filter(F.col("token").isNotNull() & (F.col("token") != "")).select(
        F.lower("token").alias("needle")).distinct()
    wanted = materialize(wanted, "needles")
    longest = F.coalesce(wanted.agg(F.max(F.length("needle"))).scalar(), F.lit(0))
    texts = changes.select(
        "ord", F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "),
                                F.coalesce("summary", F.lit("")))).alias("text"))
    blocks = materialize(text_blocks(texts, longest), "blocks")
    leads = materialize(_leads(wanted), "leads")
    first = _pieces(blocks, leads, FEW_LEADS).groupBy("needle").agg(F.min("ord").alias("ord"))
    return wanted.join(first, "needle")


def change_correlate(tokens: DataFrame, changes: DataFrame) -> DataFrame:
    """First change, in registry order, that mentions the failing token of each
    run. Rows: run, token and the change; no row without a change.

    ``tokens``: (platform, run_id, token, started_at). ``predates`` compares the times;
    it informs and never filters.
    """
    mentioned = changes.select(
        "ord", F.col("id").alias("change_id"), F.col("kind").alias("change_kind"), F.col("title").alias("change_title"),
        F.col("timestamp").alias("change_time"),
        *[F.col(c).alias("change_ref") for c in changes.columns if c == "source_ref"])
    found = first_change_per_token(tokens, changes).join(shuffled(mentioned), "ord")
    return (
        tokens.withColumn("needle", F.lower("token"))
        .join(found, "needle")
        .select(*run_key(tokens), "token", "change_id", "change_kind", "change_title",
                (F.col("change_time") <= F.col("started_at")).alias("predates"),
                *[c for c in found.columns if c == "change_ref"])
    )


# --- issues -----------------------------------------------------------------

def seed_tokens(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct tokens of pipeline, failed stage and every error message of a
    run: its search text as a set, without ever assembling the text."""
    own = run_key(runs)
    heads = runs.select(*own, F.explode(tokenize(
        F.concat_ws(" ", "pipeline", "failed_stage"))).alias("token"))
    bodies = events.filter(parsing.is_error(F.col("severity"))).select(
        *own, F.explode(tokenize(F.col("message"))).alias("token"))
    return heads.unionByName(bodies).distinct()


def _required(size: Column, threshold: float) -> Column:
    """Least overlap a set of ``size`` needs to reach the threshold at all."""
    return F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int")


def similar_incidents(seeds: DataFrame, issues: DataFrame,
                      min_similarity: float = fixed.MIN_SIMILARITY) -> DataFrame:
    """Issues with Jaccard similarity >= ``min_similarity`` per run.

    A prefix-filtered set-similarity join. Tokens are ordered from rare to
    frequent (by their count among the issues); two sets that reach the
    threshold must share a token within their prefixes, so the most frequent
    tokens are not joined at all once the sets are large enough. Runs too large
    to reach the threshold with any issue drop out by size, which also bounds
    every array built here. A token frequent on both sides is split into a
    grid of cells of at most CELL_RUNS x CELL_ISSUES rows. Each pair is
    produced once, at its first common prefix token.
    """
    issue_sets = issues.select(
        F.col("key").alias("issue_key"),
        tokenize(F.concat_ws(" ", "title", F.array_join("labels", " "))).alias("tokens"),
    ).filter(F.size("tokens") > 0).withColumn("n_issue", F.size("tokens"))
    issue_tokens = issue_sets.select("issue_key", "n_issue", F.explode("tokens").alias("token"))

    own = run_key(seeds)
    sizes = seeds.groupBy(*own).agg(F.count("*").cast("int").alias("n_run"))
    largest = issue_sets.agg(F.max("n_issue"))
    reachable = sizes.filter(_required(F.col("n_run"), min_similarity) <= largest.scalar())

    frequency = issue_tokens.groupBy("token").agg(F.count("*").alias("in_issues"))
    in_runs = seeds.groupBy("token").agg(F.count("*").alias("in_runs"))
    known = (
        frequency.join(in_runs, "token")
        .select(
            "token",
            # sorts by frequency, then token; also identifies the token
            F.concat(F.lpad(F.col("in_issues").cast("string"), 12, "0"), F.lit(":"),
                     F.col("token")).alias("item"),
            F.ceil(F.col("in_runs") / CELL_RUNS).cast("int").alias("run_cells"),
            F.ceil(F.col("in_issues") / CELL_ISSUES).cast("int").alias("issue_cells"))
    )
    known = shuffled(one_per_key(known, "token"))
    entry = F.struct("item", "run_cells", "issue_cells")

    def prefix(size: str, unknown: Column) -> Column:
        length = F.col(size) - _required(F.col(size), min_similarity) + 1 - unknown
        return F.slice("items", F.lit(1), F.greatest(length, F.lit(0)))

    run_side = (
        seeds.join(shuffled(one_per_key(reachable, *own)), own)
        .join(known, "token")
        .groupBy(*own, "n_run").agg(F.sort_array(F.collect_list(entry)).alias("items"))
        .withColumn("prefix", prefix("n_run", F.col("n_run") - F.size("items")))
        .select(*own, "n_run",
                F.transform("items", lambda x: x["item"]).alias("run_items"),
                F.transform("prefix", lambda x: x["item"]).alias("run_prefix"),
                F.explode("prefix").alias("p"))
        .select(*own, "n_run", "run_items", "run_prefix", F.col("p.item").alias("item"),
                F.expr(f"cast(pmod(xxhash64({', '.join(own)}), p.run_cells) as int)").alias("row"),
                F.explode(F.sequence(F.lit(0), F.col("p.issue_cells") - 1)).alias("column"))
    )
    # tokens no run has cannot match and are left out of the index
    issue_side = (
        issue_tokens.join(known, "token")
        .groupBy("issue_key", "n_issue").agg(F.sort_array(F.collect_list(entry)).alias("items"))
        .select("issue_key", "n_issue",
                F.transform("items", lambda x: x["item"]).alias("issue_items"),
                F.explode("items").alias("p"))
        .select("issue_key", "n_issue", "issue_items", F.col("p.item").alias("item"),
                F.expr("cast(pmod(xxhash64(issue_key), p.issue_cells) as int)").alias("column"),
                F.explode(F.sequence(F.lit(0), F.col("p.run_cells") - 1)).alias("row"))
    )
    common = F.size(F.array_intersect("run_items", "issue_items"))
    similarity = common / (F.col("n_run") + F.col("n_issue") - common)
    return (
        run_side.join(shuffled(issue_side), ["item", "row", "column"])
        .filter(F.col("item") == F.array_min(F.array_intersect("run_prefix", "issue_items")))
        .withColumn("similarity", similarity)
        .filter(F.col("similarity") >= F.lit(min_similarity))
        .select(*own, "issue_key", "similarity")
    )


def _ranked(seeds: DataFrame, issue_tokens: DataFrame) -> DataFrame:
    """token, rank (a number, rising from rare to frequent), in_issues; tokens that both sides have."""
    in_issues = issue_tokens.groupBy("token").agg(F.count("*").alias("in_issues"))
    in_runs = seeds.groupBy("token").agg(F.count("*").alias("in_runs"))
    known = in_issues.join(in_runs, "token").orderBy("in_issues", "token")  # a range partitioning: ids rise with it
    return materialize(known.select("token", F.monotonically_increasing_id().alias("rank"), "in_issues"), "ranks")


def _with_ranks(members: DataFrame, ranks: DataFrame) -> DataFrame:
    """The tokens of ``members`` that the other side has, as ranks."""
    return members.join(shuffled(one_per_key(ranks.select("token", "rank"), "token")), "token").drop("token")


def _sets(ranked: DataFrame, keys: list[str], size: str) -> DataFrame:
    return ranked.groupBy(*keys, size).agg(F.sort_array(F.collect_list("rank")).alias("ranks"))


def _token_sets(members: DataFrame, keys: list[str], ranks: DataFrame, size: str) -> DataFrame:
    """``keys``, ``size``, ranks (sorted): the tokens of each member that the other side has."""
    return _sets(_with_ranks(members, ranks), keys, size)


def _digest(size: str, ranks: Column) -> Column:
    return F.md5(F.concat_ws(",", F.col(size).cast("string"), F.transform(ranks, lambda r: r.cast("string"))))


def _classes(sets: DataFrame, size: str) -> DataFrame:
    """The distinct sets, named by a digest."""
    return sets.withColumn("set", _digest(size, F.col("ranks")))


def _families(sets: DataFrame, size: str, first_common: int) -> DataFrame:
    """With common, the ranks from ``first_common`` on, and family, which names them and the size."""
    common = F.filter("ranks", lambda r: r >= F.lit(first_common))
    return _classes(sets, size).withColumn("common", common).withColumn("family", _digest(size, F.col("common")))


def _common_ranks(run_sets: DataFrame, issue_sets: DataFrame, min_similarity: float) -> DataFrame:
    """run_set, n_run, issue_set, n_issue, common: how many ranks two sets share, where their sizes can reach the threshold.

    Each common token is a row (run_set, issue_set), counted in the map tasks; nothing but two
    names and two sizes travels. A token in very many sets of both sides is dealt over a grid of cells, and
    the size filter drops pairs that can't reach the threshold before they are counted.
    """
    left = run_sets.select(F.col("set").alias("run_set"), "n_run", F.explode("ranks").alias("rank"))
    right = issue_sets.select(F.col("set").alias("issue_set"), "n_issue", F.explode("ranks").alias("rank"))
    cells = left.groupBy("rank").agg(F.ceil(F.count("*") / CELL_RUNS).cast("int").alias("rows")).join(
        right.groupBy("rank").agg(F.ceil(F.count("*") / CELL_ISSUES).cast("int").alias("columns")), "rank")
    cells = shuffled(one_per_key(cells, "rank"))
    left = left.join(cells, "rank").select(
        "rank", "run_set", "n_run", F.pmod(F.xxhash64("run_set"), "rows").cast("int").alias("row"),
        F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    right = right.join(cells, "rank").select(
        "rank", "issue_set", "n_issue", F.pmod(F.xxhash64("issue_set"), "columns").cast("int").alias("column"),
        F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    fits = F.least("n_run", "n_issue") >= F.greatest("n_run", "n_issue") * F.lit(min_similarity) - F.lit(1e-9)
    return left.join(shuffled(right), ["rank", "row", "column"]).filter(fits).groupBy(
        "run_set", "n_run", "issue_set", "n_issue").agg(F.count("*").alias("common"))


def _similarity(common: Column) -> Column:
    return common / (F.col("n_run") + F.col("n_issue") - common)


def _best(pairs: DataFrame, name: str, top: int) -> DataFrame:
    """``name``, best: the ``top`` most similar (similarity, ord, issue_key, n_issue) of the issues that head a class."""
    order = Window.partitionBy(name).orderBy(F.desc("similarity"), "ord", "issue_key")
    return pairs.select(name, "similarity", "n_issue", F.explode("heads").alias("h")).select(name, "similarity", "n_issue", "h.*") \
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top) \
        .groupBy(name).agg(F.collect_list(F.struct("similarity", "ord", "issue_key", "n_issue")).alias("best"))


def _issue_classes(known: DataFrame, name: str, ranks: str, top: int) -> DataFrame:
    """``name``, n_issue, weight (issues), ranks, heads: each class with the first ``top`` of its issues."""
    # the rank filter is applied before the shuffle too
    place = F.row_number().over(Window.partitionBy(name).orderBy("ord", "issue_key"))
    counted = known.groupBy(name, "n_issue").agg(F.count("*").alias("weight"), F.first(ranks).alias("ranks"), F.first("common").alias("common"))
    heads = known.withColumn("place", place).filter(F.col("place") <= top).groupBy(name).agg(
        F.collect_list(F.struct("ord", "issue_key")).alias("heads"))
    return counted.join(heads, name)


def related_issues(seeds: DataFrame, issues: DataFrame, top: int = 3,
                   min_similarity: float = fixed.MIN_SIMILARITY) -> DataFrame:
    """Per run with a related issue: n_related, and the ``top`` most similar as (rank, issue_key, similarity).

    The pairs of ``similar_incidents`` are never built: runs with equal token sets are one, issues
    with equal token sets are one with a count and their first ``top`` keys (by ``ord``).

    Nor is each distinct set compared with each that shares a token with it, as one word that every issue has
    would make that all pairs. Sets that differ only in tokens of few issues (a number, a name) are one *family*, and families
    are compared by their common tokens. That is exact but for the pairs of sets that share a token of few issues, too: those
    are listed and are more similar than their families, so they add what their families do not reach and take precedence among the most similar.
    """
    own = run_key(seeds)
    issue_sets = issues.select(
        F.col("key").alias("issue_key"), "ord",
        tokenize(F.concat_ws(" ", "title", F.array_join("labels", " "))).alias("tokens"),
    ).filter(F.size("tokens") > 0).withColumn("n_issue", F.size("tokens"))
    issue_tokens = issue_sets.select("issue_key", "ord", "n_issue", F.explode("tokens").alias("token"))
    sizes = seeds.groupBy(*own).agg(F.count("*").cast("int").alias("n_run"))
    largest = issue_sets.agg(F.max("n_issue"))
    reachable = sizes.filter(_required(F.col("n_run"), min_similarity) <= largest.scalar())
    ranks = _ranked(seeds, issue_tokens)
    first_common = ranks.filter(F.col("in_issues") > FEW_ISSUES).agg(F.min("rank")).first()[0]
    first_common = 2**63 - 1 if first_common is None else first_common

    # most tokens of a run are in no issue: they go before the sizes are looked up
    sized = _with_ranks(seeds, ranks).join(shuffled(one_per_key(reachable, *own)), own)
    runs = materialize(_families(_sets(sized, own, "n_run"), "n_run", first_common), "run_sets")
    drop_shuffles(seeds.sparkSession)
    known = materialize(_families(_token_sets(issue_tokens, ["issue_key", "ord"], ranks, "n_issue"), "n_issue", first_common), "issue_sets")

    families = materialize(_issue_classes(known, "family", "common", top), "issue_families")
    sides = runs.groupBy(F.col("family").alias("set"), "n_run").agg(F.first("common").alias("ranks"))
    alike = _common_ranks(sides, families.withColumnRenamed("family", "set"), min_similarity) \
        .withColumn("similarity", _similarity(F.col("common"))).filter(F.col("similarity") >= F.lit(min_similarity)) \
        .select(F.col("run_set").alias("run_family"), F.col("issue_set").alias("family"), "similarity") \
        .join(shuffled(families.select("family", "n_issue", "weight", "heads")), "family")
    alike = materialize(alike, "family_pairs")
    of_family = alike.groupBy("run_family").agg(F.sum("weight").alias("n_family")).join(
        _best(alike, "run_family", top).withColumnRenamed("best", "best_family"), "run_family")

    def rare(sets: DataFrame) -> DataFrame:
        return sets.withColumn("ranks", F.filter("ranks", lambda r: r < F.lit(first_common)))

    sets = materialize(runs.groupBy("set", "family", "n_run").agg(F.first("ranks").alias("ranks"), F.first("common").alias("common")), "distinct_sets")
    classes = _issue_classes(known, "set", "ranks", top).withColumnRenamed("set", "issue_set")
    in_run, in_issue = F.col("run_common"), F.col("issue_common")
    shared = F.size(F.filter(in_issue, lambda r: F.array_contains(in_run, r)))
    listed = _common_ranks(rare(sets), rare(known.groupBy("set", "n_issue").agg(F.first("ranks").alias("ranks"))), min_similarity) \
        .join(shuffled(sets.select(F.col("set").alias("run_set"), F.col("common").alias("run_common"))), "run_set") \
        .join(shuffled(classes.select("issue_set", "weight", "heads", F.col("common").alias("issue_common"))), "issue_set") \
        .withColumn("shared", shared).withColumn("similarity", _similarity(F.col("common") + F.col("shared"))) \
        .filter(F.col("similarity") >= F.lit(min_similarity)) \
        .withColumn("new", (F.col("shared") == 0) | (_similarity(F.col("shared")) < F.lit(min_similarity))) \
        .select("run_set", "n_issue", "weight", "heads", "similarity", "new")
    listed = materialize(listed, "set_pairs")
    of_set = listed.groupBy("run_set").agg(F.sum(F.when(F.col("new"), F.col("weight")).otherwise(0)).alias("n_set")).join(
        _best(listed, "run_set", top).withColumnRenamed("best", "best_set"), "run_set")

    # a set has at most ``top`` of either kind; an issue listed by both is as similar as its set
    merged = F.expr(f"""slice(sort_array(transform(
        concat(coalesce(best_set, array()), filter(coalesce(best_family, array()), f -> not exists(coalesce(best_set, array()),
            s -> s.ord <=> f.ord and s.issue_key <=> f.issue_key and s.n_issue = f.n_issue))),
        x -> named_struct('less', -x.similarity, 'ord', x.ord, 'issue_key', x.issue_key, 'similarity', x.similarity))), 1, {int(top)})""")
    per_set = sets.select(F.col("set").alias("run_set"), F.col("family").alias("run_family")) \
        .join(shuffled(of_family), "run_family", "left").join(shuffled(of_set), "run_set", "left") \
        .filter(F.col("best_set").isNotNull() | F.col("best_family").isNotNull()) \
        .select("run_set", F.expr("coalesce(n_family, 0L) + coalesce(n_set, 0L)").alias("n_related"), F.transform(
            merged, lambda x, i: F.struct((i + 1).alias("rank"), x["issue_key"].alias("issue_key"), x["similarity"].alias("similarity"))).alias("top"))
    return runs.select(*own, F.col("set").alias("run_set")).join(shuffled(one_per_key(per_set, "run_set")), "run_set").select(
        *own, "n_related", "top")
