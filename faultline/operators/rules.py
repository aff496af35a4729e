"""Many signatures against many events, without trying each on each."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dialect import SPACE_CHARS, java, text
from ..functions.literals import SIZE, required_literals
from ..functions.signatures import signature_matches

_RULE = pa.struct([
    ("sig_ord", pa.int32()), ("signature", pa.string()), ("category", pa.string()), ("only_on", pa.string()),
    ("weight", pa.int32()), ("pattern", pa.string()), ("literal", pa.string()), ("literals", pa.list_(pa.string())),
    ("title", pa.string()), ("parts", pa.list_(pa.struct([("plain", pa.string()), ("grp", pa.int32())]))),
    ("groups", pa.list_(pa.int32())), ("path_group", pa.int32()), ("line_group", pa.int32())])


def rule_index(spark: SparkSession, signatures: list[tuple]) -> tuple[DataFrame | None, list[str], list[int]]:
    """(index, its grams, positions of the signatures without a required literal).

    One row per required literal of a signature, under the gram of that literal
    that the fewest literals of the list share.
    """
    needed = [required_literals(s[6]) for s in signatures]
    grams_of = {x: sorted({x[i:i + SIZE] for i in range(len(x) - SIZE + 1)}) for found in needed for x in found}
    shared = Counter(g for grams in grams_of.values() for g in grams)
    rows = []
    for ord_, (sig, category, only_on, weight, groups, title, raw, ci) in enumerate(signatures):
        pieces = re.split(r"\$(\d)", title)
        path, line = fixed.SIGNATURE_CODE_GROUPS.get(sig, (None, None))
        rule = {
            "sig_ord": ord_, "signature": sig, "category": category, "only_on": only_on, "weight": weight,
            "pattern": java(raw, ci), "literals": needed[ord_], "groups": list(groups or ()),
            "title": title if len(pieces) == 1 else None,
            "parts": [{"plain": None, "grp": int(p)} if i % 2 else {"plain": p, "grp": None}
                      for i, p in enumerate(pieces) if p],
            "path_group": path, "line_group": line}
        rows += [{"__gram": min(grams_of[x], key=lambda g: (shared[g], g)), "__rule": {**rule, "literal": x}}
                 for x in needed[ord_]]
    always = [i for i, found in enumerate(needed) if not found]
    if not rows:
        return None, [], always
    table = pa.Table.from_pylist(rows, schema=pa.schema([("__gram", pa.string()), ("__rule", _RULE)]))
    return spark.createDataFrame(table), sorted({r["__gram"] for r in rows}), always


def indexed_matches(events: DataFrame, message: str, platform: str, code: str,
                    signatures: list[tuple]) -> DataFrame:
    """``events`` with one match ``m`` per row, the same as exploded ``signature_matches``.

    A text that matches a signature contains one of its required literals, so
    also that literal's gram. The grams of an event that the index knows are
    joined with it (the index has the size of the list, and the planner
    broadcasts it while it is small); only signatures whose literal the event
    does contain run their expression. Of several literals of a signature the
    event's first counts, so nothing is told apart by a shuffle. Candidates are
    sorted by signature within their task, so that each expression is compiled
    once there and not once a row. They are sorted without the expression, long
    beside an event, and get it after: the list is broadcast, which keeps the
    order. Signatures without a required literal run on
    every event, as in ``signature_matches``.

    An event whose message is null matches nothing.
    """
    index, grams, always = rule_index(events.sparkSession, signatures)
    parts = []
    if index is not None:
        known = ", ".join(map(text, grams))
        leads = (f"filter(array_distinct(regexp_extract_all(lower({message}), '(?s)(?=(.{{{SIZE}}}))', 1)), "
                 f"g -> g in ({known}))")
        keys = ["sig_ord", "only_on", "literal", "literals"]  # what tells candidates apart; the rest is long
        leading = index.select("__gram", F.struct(*[f"__rule.{k}" for k in keys]).alias("__lead"))
        rules = index.select(F.col("__rule.sig_ord").alias("__ord"), "__rule").filter("__rule.literal = __rule.literals[0]")
        joined = events.withColumn("__gram", F.explode(F.expr(leads))).join(F.broadcast(leading), "__gram").filter(
            f"contains(lower({message}), __lead.literal) "
            f"and (__lead.only_on is null or {platform} is null or {platform} = __lead.only_on) "
            f"and filter(__lead.literals, x -> contains(lower({message}), x))[0] = __lead.literal")
        extract = f"regexp_extract({message}, __rule.pattern, {{}})"
        title = (f"coalesce(__rule.title, trim(both {text(SPACE_CHARS)} from array_join(transform(__rule.parts, "
                 f"p -> coalesce(p.plain, {extract.format('p.grp')})), '')))")
        token = (f"try_element_at(filter(transform(__rule.groups, n -> nullif({extract.format('n')}, '')), "
                 "x -> x is not null), 1)")
        place = (f"if(__rule.path_group is null, {code}, named_struct("
                 f"'path', {extract.format('__rule.path_group')}, "
                 f"'line', try_cast({extract.format('__rule.line_group')} as bigint), "
                 "'symbol', cast(null as string)))")
        # the generators keep the sort in place: it would be dropped below a join, and a filter moved below it
        ordered = joined.select(*events.columns, F.col("__lead.sig_ord").alias("__found")).sortWithinPartitions("__found")
        ruled = ordered.select(*events.columns, F.explode(F.array("__found")).alias("__ord")).join(F.broadcast(rules), "__ord")
        parts.append(ruled.select(*events.columns, F.explode(F.expr(
            f"array_compact(array(case when regexp_instr({message}, __rule.pattern) > 0 then named_struct("
            "'sig_ord', __rule.sig_ord, 'signature', __rule.signature, 'category', __rule.category, "
            f"'weight', __rule.weight, 'title', {title}, 'token', {token}, 'code', {place}) end))")).alias("m")))
    if always:
        parts.append(events.withColumn(
            "m", F.explode(signature_matches(message, platform, code, signatures, always))))
    if not parts:
        raise ValueError("no signatures")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
