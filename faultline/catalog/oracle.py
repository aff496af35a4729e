"""The same queries as plain SQL for DuckDB, written against the raw tables.

``CTES`` are named building blocks; ``sql(query)`` prepends the ones a query
needs. Patterns come from the fixed values in RE2 notation. Where the Spark side
avoids an all-pairs comparison, the oracle does the naive comparison.
"""

from __future__ import annotations

import re

from ..functions import fixed
from ..functions.dialect import SPACE_CHARS, re2
from . import adapters as A

STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def q(text: str) -> str:
    """String literal."""
    return "'" + text.replace("'", "''") + "'"


SPACE = q(SPACE_CHARS)
ERR = "severity in ('error','fatal')"


def match(col: str, pattern: str, ci: bool = False) -> str:
    return f"regexp_matches({col}, {q(re2(pattern, ci))})"


def group(col: str, pattern: str, n: int, ci: bool = False) -> str:
    return f"nullif(regexp_extract({col}, {q(re2(pattern, ci))}, {n}), '')"


def severity(line: str) -> str:
    token = f"regexp_extract({line}, {q(re2(fixed.LEVEL_TOKEN))}, 1)"
    levels = " ".join(f"when {q(k)} then {q(v)}" for k, v in fixed.LEVEL_SEVERITY.items())
    bad = " or ".join(match(line, p, ci) for p, ci in fixed.ERROR_PATTERNS)
    return f"case {token} {levels} else case when {bad} then 'error' else 'info' end end"


def template(message: str) -> str:
    out = message
    for pattern, ci, to in fixed.TEMPLATE_STEPS:
        out = f"regexp_replace({out}, {q(re2(pattern, ci))}, {q(to)}, 'g')"
    return f"lower(trim({out}, {SPACE}))"


def cascade(message: str) -> str:
    return "(" + " or ".join(
        match(f"trim({message}, {SPACE})", p, True) for p in fixed.CASCADE_PHRASES) + ")"


def redact(source: str, col: str, keys: list[str], level: str = "strict",
           only: str | None = None) -> str:
    """SELECT keys, col (redacted), hits (list), n_hits."""
    rules = [r for r in fixed.REDACTION_RULES
             if (level == "strict" or not r[4]) and only in (None, r[0])]
    inner = f"select {', '.join(keys)}, {col} as t, []::varchar[] as hits from {source}"
    for name, pattern, ci, to, _ in rules:
        p, r = q(re2(pattern, ci)), q(re.sub(r"\$(\d)", r"\\\1", to))
        inner = (
            f"select {', '.join(keys)}, case when f then regexp_replace(t, {p}, {r}, 'g') else t end as t, "
            f"case when f then list_append(hits, {q(name)}) else hits end as hits "
            f"from (select *, regexp_matches(t, {p}) as f from ({inner}))")
    return f"select {', '.join(keys)}, t as {col}, hits, len(hits) as n_hits from ({inner})"


def redact_scalar(expr: str) -> str:
    for _, pattern, ci, to, _ in fixed.REDACTION_RULES:
        to = re.sub(r"\$(\d)", r"\\\1", to)
        expr = f"regexp_replace({expr}, {q(re2(pattern, ci))}, {q(to)}, 'g')"
    return expr


def label(col: str) -> str:
    return f"case {col} " + " ".join(
        f"when {q(k)} then {q(v)}" for k, v in fixed.CATEGORY_LABELS.items()) + " end"


def tokens(expr: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(lower({expr}), '[^a-z0-9]+'), "
            f"lambda w: length(w) > 2))")


def jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return (f"case when len({a}) = 0 or len({b}) = 0 then 0.0 "
            f"else {common}::double / (len({a}) + len({b}) - {common}) end")


def short_id(expr: str) -> str:
    codes = (f"list_prepend(2166136261::bigint, list_transform(string_split({expr}, ''), "
             f"lambda c: unicode(c)::bigint))")
    fnv = f"list_reduce({codes}, lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    return f"substr(lpad(lower(to_base({fnv}, 36)), 7, '0'), 1, 7)"


def confidence(score: str) -> str:
    return f"case when {score} >= 0.75 then 'high' when {score} >= 0.5 then 'medium' else 'low' end"


def signature_structs() -> str:
    items = []
    for i, (sig, cat, platform, weight, groups, title, pattern, ci) in enumerate(fixed.SIGNATURES):
        cond = match("message", pattern, ci)
        if platform:
            cond = f"platform = {q(platform)} and {cond}"
        parts = re.split(r"\$(\d)", title)
        rendered = " || ".join(
            q(p) if n % 2 == 0 else f"coalesce({group('message', pattern, int(p), ci)}, '')"
            for n, p in enumerate(parts) if p != "")
        token = "coalesce(" + ", ".join(
            group("message", pattern, g, ci) for g in groups) + ")" if groups else "null::varchar"
        if groups and len(groups) == 1:
            token = group("message", pattern, groups[0], ci)
        path, line = "code_path", "code_line"
        if sig in fixed.SIGNATURE_CODE_GROUPS:
            a, b = fixed.SIGNATURE_CODE_GROUPS[sig]
            path = group("message", pattern, a, ci)
            line = f"try_cast({group('message', pattern, b, ci)} as bigint)"
        items.append(
            f"case when {cond} then {{'sig_ord': {i}::bigint, 'signature': {q(sig)}, "
            f"'category': {q(cat)}, 'weight': {weight}::bigint, 'title': trim({rendered}, {SPACE}), "
            f"'token': {token}, 'code_path': {path}, 'code_line': {line}}} end")
    return "[" + ", ".join(items) + "]"


def knowledge_values() -> str:
    rows = []
    for cat in fixed.CATEGORY_LABELS:
        verify, remediate = fixed.KNOWLEDGE.get(cat, fixed.GENERIC_KNOWLEDGE)
        steps = [("verification", t, "false") for t in verify] + \
                [("remediation", t, "true") for t in remediate]
        rows += [f"({q(cat)}, {i}::bigint, {q(kind)}, {q(t)}, {m})"
                 for i, (kind, t, m) in enumerate(steps)]
    return ", ".join(rows)


CTES = {
    "raw": "select *, cast(props->>'$.k' as int) as k, "
           "cast(floor((day(ts) - 1) / 7) as int) as wk from events",
    "lines": f"select {A.RUN_ID} as run_id, {A.PLATFORM} as platform, event_id as seq, "
             f"{A.line_case(STAMP)} as line, {A.SOURCE} as source, ts from raw",
    "facts": "select user_id, wk, count(*) as n, min(k) as min_k, max(k) as max_k, "
             "min(event_type) as mode, min(ts) as started from raw group by all",
    "runs": f"select {A.RUN_ID} as run_id, {A.PLATFORM} as platform, {A.PIPELINE} as pipeline, "
            f"{A.FAILED_STAGE} as failed_stage, {A.BASELINE} as baseline_id, "
            "strftime(started, '%Y-%m-%d %H:%M:%S') as started_at, mode, n, user_id, wk, min_k, max_k "
            "from facts",
    "parsed": f"select run_id, platform, seq, ts, source, line, {severity('line')} as severity, "
              f"trim(line, {SPACE}) as message from lines",
    "traced": f"""select *, {match('message', fixed.CODE_REF)} as is_frame,
        not {match('message', fixed.CODE_REF)} and severity = 'error'
        and regexp_matches(message, '(Error|Exception):') as raises from parsed""",
    # the pending frame of a line: the last frame, unless an exception line in
    # between has taken it
    "coded": f"""select p.run_id, p.seq, p.severity,
          {group('coalesce(f.message, p.message)', fixed.CODE_REF, 1)} as path,
          try_cast({group('coalesce(f.message, p.message)', fixed.CODE_REF, 2)} as bigint) as line,
          {group('coalesce(f.message, p.message)', fixed.CODE_REF, 3)} as symbol
        from traced p left join traced f on p.raises and f.is_frame and f.run_id = p.run_id
          and f.seq = (select max(x.seq) from traced x where x.run_id = p.run_id and x.is_frame and x.seq < p.seq)
          and not exists (select 1 from traced y where y.run_id = p.run_id and y.raises
                          and y.seq > f.seq and y.seq < p.seq)""",
    "redacted": redact("parsed", "message", ["run_id", "platform", "seq", "ts", "source", "severity"]),
    "errs": f"select *, {template('message')} as template from redacted where {ERR}",
    "firsts": f"""select *, {cascade('message')} as cascade from (
        select *, count(*) over (partition by run_id, template) as n_events,
               row_number() over (partition by run_id, template order by seq) as rn from errs)
        where rn = 1""",
    "meaningful": """select * from (select *, bool_or(not cascade) over (partition by run_id) as has_cause
        from firsts) where not cascade or not has_cause""",
    "counters": """select run_id, cast(sum(n_events) as bigint) as errors, count(*) as templates,
        cast(sum(n_events) - count(*) as bigint) as removed_duplicates,
        cast(case when bool_and(cascade) then 0 else count(*) filter (cascade) end as bigint) as removed_cascades
        from firsts group by run_id""",
    "coded_meaningful": "select m.*, c.path as code_path, c.line as code_line from meaningful m "
                        "left join coded c on c.run_id = m.run_id and c.seq = m.seq",
    "matches": f"""select run_id, seq, source, message, unnest(m, recursive := false) as m from (
        select *, list_filter({signature_structs()}, lambda x: x is not null) as m from coded_meaningful)""",
    "hits": "select run_id, seq, source, message, m.sig_ord, m.signature, m.category, m.weight, m.title, "
            "m.token, m.code_path, m.code_line from matches",
    "categories": """select *, row_number() over (partition by run_id order by weight desc, fs, fo) as rank
        from (select run_id, category, cast(sum(weight) as bigint) as weight, count(*) as matches,
                     min(seq) as fs, arg_min(sig_ord, seq * 100 + sig_ord) as fo
              from hits group by run_id, category)""",
    "classified": """select r.run_id, coalesce(c.category, 'unknown') as category,
        case when c.weight is null then 0.0 else least(1.0, c.weight / 100.0::double / 1.6::double) end as class_score
        from runs r left join categories c on c.run_id = r.run_id and c.rank = 1""",
    "strong": """select * from (select *, row_number() over (partition by run_id order by seq, sig_ord) as rn
        from hits where weight >= 70) where rn = 1""",
    "earliest": """select f.run_id, coalesce(s.seq, f.seq) as earliest_seq,
        coalesce(s.message, f.message) as earliest_message,
        case when s.run_id is not null then s.source else f.source end as earliest_source,
        case when s.run_id is not null then 'signature' when f.cascade then 'first_error'
             else 'first_non_cascade_error' end as reason,
        s.title as match_title, s.token, s.code_path, s.code_line
        from (select *, row_number() over (partition by run_id order by seq) as n from meaningful) f
        left join strong s on s.run_id = f.run_id where f.n = 1""",
    "pairs": "select r.run_id, r.baseline_id, r.platform from runs r join runs b "
             "on r.baseline_id = b.run_id and r.platform = b.platform",
    "snapshots": """select run_id, 0 as ord, 'dependencies' as kind, 'lib_a' as key, '1.' || cast(min_k % 3 as string) as value from runs
        union all select run_id, 1, 'libraries', 'lib_b', '2.' || cast(max_k % 5 as string) from runs
        union all select run_id, 2, 'environment', 'py', '3.' || cast(n % 2 as string) from runs
        union all select run_id, 3, 'query', 'text', 'q' || cast(max_k % 4 as string) from runs""",
    "entries": """select run_id, 'parameters' as section, 'mode' as key, mode as value from runs
        union all select run_id, 'parameters', 'rows', cast(n as string) from runs
        union all select run_id, 'dependencies', key, value from snapshots where kind in ('dependencies','libraries')
        union all select run_id, 'environment', key, value from snapshots where kind in ('environment','runtime')
        union all select run_id, 'configuration', kind || '.' || key, value from snapshots
                  where kind not in ('dependencies','libraries')""",
    "diffs": """select coalesce(a.run_id, b.run_id) as run_id, coalesce(a.section, b.section) as section,
        coalesce(a.key, b.key) as key, b.value as before, a.value as after
        from (select e.* from entries e join pairs p on p.run_id = e.run_id) a
        full outer join (select p.run_id, e.section, e.key, e.value from entries e
                         join pairs p on p.baseline_id = e.run_id) b
        on a.run_id = b.run_id and a.section = b.section and a.key = b.key
        where a.value is distinct from b.value""",
    "new_err": """select e.run_id, min(e.seq) as seq, e.message from errs e join pairs p on p.run_id = e.run_id
        where not exists (select 1 from errs x where x.run_id = p.baseline_id and x.template = e.template)
        group by e.run_id, e.message""",
    "ddl": """select p_partkey as ord, 'ddl-' || cast(p_partkey as string) as id,
        'RENAME COLUMN col_' || cast(p_size as string) as title, p_name as summary,
        '2024-01-' || lpad(cast(1 + p_partkey % 28 as string), 2, '0') || ' 00:00:00' as timestamp from part""",
    "needles": "select distinct lower(token) as needle from earliest where token is not null",
    "needle_change": """select n.needle, min(d.ord) as ord from needles n
        join ddl d on contains(lower(d.title || ' ' || d.summary), n.needle) group by n.needle""",
    "change_hits": """select e.run_id, e.token, d.id as change_id, 'schema_change' as change_kind,
        d.title as change_title, d.timestamp <= r.started_at as predates
        from earliest e join needle_change n on n.needle = lower(e.token) join ddl d on d.ord = n.ord
        join runs r on r.run_id = e.run_id""",
    "issue_rows": """select p_partkey as ord, 'DATA-' || cast(p_partkey as string) as key,
        p_name || ' ' || cast(p_partkey as string) || ' on node' || cast(p_partkey as string) || ' rack' || cast(p_partkey as string) as title,
        case when p_size % 2 = 0 then 'Done' else 'Open' end as status, p_brand || ' ' || p_type as labels,
        'https://issues.example/DATA-' || cast(p_partkey as string) as url from part""",
    "seeds": f"""select distinct run_id, token from (
        select run_id, unnest({tokens("message")}) as token from errs
        union all select run_id, unnest({tokens("concat_ws(' ', pipeline, failed_stage)")}) from runs)""",
    "issue_tokens": f"select key, unnest({tokens('''title || ' ' || labels''')}) as token from issue_rows",
    "related": """select run_id, issue_key, similarity from (
        select s.run_id, i.key as issue_key, count(*) as common, any_value(a.n) as na, any_value(b.n) as nb,
               count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) as similarity
        from seeds s join issue_tokens i on i.token = s.token
        join (select run_id, count(*) as n from seeds group by run_id) a on a.run_id = s.run_id
        join (select key, count(*) as n from issue_tokens group by key) b on b.key = i.key
        group by s.run_id, i.key) where similarity >= 0.05""",
    "hit_counts": "select run_id, cast(sum(n_hits) as bigint) as hit_count from redacted group by run_id",
    "base": """select r.*, c.category, c.class_score, e.earliest_seq, e.earliest_message, e.earliest_source,
        e.reason, e.match_title, e.token, e.code_path, e.code_line, coalesce(h.hit_count, 0) as hit_count,
        coalesce(k.removed_duplicates, 0) as removed_duplicates, coalesce(k.removed_cascades, 0) as removed_cascades,
        coalesce((select count(*) from meaningful m where m.run_id = r.run_id), 0) as meaningful,
        p.run_id is not null as compared,
        coalesce((select count(*) from diffs d where d.run_id = r.run_id and d.section = 'dependencies'), 0) as changed_dependencies
        from runs r join classified c on c.run_id = r.run_id
        left join earliest e on e.run_id = r.run_id left join hit_counts h on h.run_id = r.run_id
        left join counters k on k.run_id = r.run_id left join pairs p on p.run_id = r.run_id""",
    "scored_off": """select *, null::varchar as change_id, null::varchar as change_kind, null::varchar as change_title,
        null::boolean as predates, 0::bigint as related_issues,
        case when compared and starts_with(category, 'deps.') and changed_dependencies > 0
             then least(1.0, class_score + 0.12) else class_score end as raw_score from base""",
    "scored_on": """select *, case when related_issues > 0 then least(1.0, s2 + 0.03) else s2 end as raw_score from (
        select *, case when compared and starts_with(category, 'deps.') and changed_dependencies > 0
                       then least(1.0, s1 + 0.12) else s1 end as s2 from (
        select b.*, c.change_id, c.change_kind, c.change_title, c.predates,
               coalesce((select count(*) from related x where x.run_id = b.run_id), 0) as related_issues,
               case when c.change_id is not null then least(1.0, b.class_score + 0.25) else b.class_score end as s1
        from base b left join change_hits c on c.run_id = b.run_id))""",
    "knowledge": f"select * from (values {knowledge_values()}) t(category, ord, kind, description, mutates)",
}


def _hypotheses(scored: str) -> str:
    alt = "least(0.6, c.weight / 100.0::double / 2.0::double)"
    return f"""select *, row_number() over (partition by run_id order by score desc, ord) as rank from (
        select run_id, 0 as ord, {short_id("'h-primary' || category || coalesce(token, '')")} as hypothesis_id,
          category, coalesce(match_title, {label('category')}) as title,
          case when earliest_seq is not null then 'The earliest meaningful failure matches the ' || {label('category')}
                 || ' pattern; later log lines are downstream effects.'
               else 'Classification derived from aggregate error signatures (' || {label('category')} || ').' end as rationale,
          {confidence('raw_score')} as confidence, round(raw_score, 3) as score, code_path, code_line from {scored}
        union all
        select c.run_id, c.rank - 1, {short_id("'h-alt' || c.category")}, c.category, {label('c.category')},
          'Secondary signal: ' || cast(c.matches as string) || ' matching signature(s) for ' || {label('c.category')} || '.',
          {confidence(alt)}, round({alt}, 3), null, null
        from categories c where c.rank in (2, 3) and {alt} >= 0.25)"""


CTES["hyp_on"] = _hypotheses("scored_on")
CTES["hyp_off"] = _hypotheses("scored_off")


def _incidents(scored: str, hyp: str) -> str:
    return f"""select s.run_id, {short_id("'inc' || s.run_id")} as incident_id,
        s.pipeline || ': ' || h.title as title, s.platform, s.pipeline,
        coalesce(s.failed_stage, s.earliest_source) as failed_stage, h.category, h.confidence, h.score,
        s.pipeline || ' failed with probable cause: ' || h.title || '.' ||
          coalesce(' The earliest meaningful error was: ' || s.earliest_message, '') as summary,
        case when s.meaningful > 0 then 'completed' else 'insufficient_evidence' end as status,
        list_filter([
          case when s.hit_count > 0 then 'Redacted ' || cast(s.hit_count as string) || ' sensitive value(s) before analysis.' end,
          case when s.removed_duplicates + s.removed_cascades > 0 then 'Collapsed ' || cast(s.removed_duplicates as string)
            || ' duplicate and ' || cast(s.removed_cascades as string) || ' cascading error line(s).' end,
          case when not s.compared then 'No baseline run provided; add one with --baseline for stronger correlation.' end],
          lambda x: x is not null) as notes,
        s.meaningful, s.related_issues, s.reason, s.token, s.predates
        from {scored} s join {hyp} h on h.run_id = s.run_id and h.rank = 1"""


CTES["inc_on"] = _incidents("scored_on", "hyp_on")
CTES["inc_off"] = _incidents("scored_off", "hyp_off")

CTES["top_deps"] = """select *, row_number() over (partition by run_id order by lower(key), key) as n
    from diffs where section = 'dependencies'"""
CTES["top_params"] = """select *, row_number() over (partition by run_id order by lower(key), key) as n
    from diffs where section = 'parameters'"""


def _change_statement(noun: str) -> str:
    return (f"'{noun} ' || d.key || ' changed ' || coalesce(d.before, '(absent)') || ' → ' || "
            f"coalesce(d.after, '(absent)') || ' vs. last success.'")


# evidence of the offline investigation (all kinds)
CTES["evidence_off"] = f"""
    select run_id, category, 'e-earliest' || cast(earliest_seq as string) as seed, 'confirmed' as kind,
      'Earliest meaningful error (line ' || cast(earliest_seq as string) || '): ' || earliest_message as statement
      from scored_off where earliest_seq is not null
    union all select run_id, category, 'e-token' || token, 'inference',
      'Failure centers on "' || token || '"; no correlated change was found in connected systems.'
      from scored_off where token is not null
    union all select run_id, category, 'e-nobaseline', 'missing_information',
      'No successful baseline run was supplied; cross-run comparison was skipped.' from scored_off where not compared
    union all select s.run_id, s.category, 'e-dep' || d.key, 'strong_correlation', {_change_statement('Dependency')}
      from top_deps d join scored_off s on s.run_id = d.run_id where d.n <= 5 and starts_with(s.category, 'deps.')
    union all select s.run_id, s.category, 'e-param' || d.key, 'inference', {_change_statement('Parameter')}
      from top_params d join scored_off s on s.run_id = d.run_id where d.n <= 5
    union all select run_id, category, 'e-alt' || category, 'inference',
      cast(matches as string) || ' signature match(es) contributed to this category.'
      from categories where rank in (2, 3) and least(0.6, weight / 200.0::double) >= 0.25"""


def sql(final: str, **own: str) -> str:
    """Prepend the CTEs the query needs, in definition order; ``own`` replaces some."""
    CTES = globals()["CTES"] | own
    needed, todo = set(), [final]
    while todo:
        words = set(re.findall(r"[a-z_]+", todo.pop()))
        for name in CTES:
            if name in words and name not in needed:
                needed.add(name)
                todo.append(CTES[name])
    ctes = ", ".join(f"{n} as ({b})" for n, b in CTES.items() if n in needed)
    return f"with {ctes} {final}" if ctes else final


EV = short_id("seed") + " as evidence_id"
STEP_COUNT = "(select count(*) from knowledge k where k.category = h.category)"
SECRET_SRC = f"(select doc_id, {A.SECRET_TEXT} as text from documents)"
UNTRUSTED_SRC = f"(select conv_id, turn, {A.UNTRUSTED_TEXT} as text from conversations)"
MARKER_LIST = "list_filter([" + ", ".join(
    group("text", p, 0, True) for p in fixed.INJECTION_MARKERS) + "], lambda x: x is not null)"
NEUTRAL = "regexp_replace(regexp_replace(text, '`{3,}', '''''''', 'g'), '(?i)</?(system|assistant|user)>', '', 'g')"
META = f"""select r.run_id as rid, r.platform, r.failed_stage, r.n, r.min_k, r.wk, r.user_id,
    case when r.user_id % 4 in (0, 1) then 'own' when r.user_id % 4 = 2 then 'shared' end as src from runs r"""
FAIL_STEP = """case when o_orderstatus = 'F' then
    case o_custkey % 3 when 0 then 'build / Set up' when 1 then 'load / Load' end end"""
STORE_ERROR = """case when l_returnflag = 'N' and l_linestatus = 'F' then 'E11000 duplicate key error collection: x'
    when l_returnflag = 'A' and l_partkey > 10 * greatest(1, cast(l_quantity as bigint) - 1)
    then 'COLLSCAN: no index available; examined ' || cast(l_partkey as string) || ' docs to return '
         || cast(cast(l_quantity as bigint) - 1 as string) end"""
OP = "case when l_linenumber % 2 = 0 then 'find' else 'insert' end"
OP_ID = "'op_' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string)"
PLACE = "'analytics.c' || cast(l_suppkey % 9 as string)"
QUERY_ID = "cast(l_orderkey as string) || '-' || cast(l_linenumber as string)"
LAST = "list_extract(string_split(message, chr(10)), 1)"

ORACLE: dict[str, str] = {}


def oracle(name: str, final: str) -> None:
    ORACLE[name] = sql(final)


# sources
oracle("log_lines_scan", f"""select doc_id, cast(pos - 1 as bigint) as seq, line from (
    select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos from (
      select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'),
             lambda x: rtrim(x, {SPACE})), lambda x: trim(x, {SPACE}) <> '') as l from documents))""")
BLANK = "cast(split_part(run_id, '-', 1) as int) % 10 = 9"
oracle("log_files_scan", f"""select run_id, row_number() over (partition by run_id order by seq) - 1 as seq, line
    from lines where not {BLANK}
    union all select distinct run_id, null, null from lines where {BLANK}""")
oracle("run_meta_join", f"""select '/logs/' || rid || '/run.log' as run_id,
    case when src is null then 'local' else platform end as platform,
    case src when 'own' then 'own ' || cast(user_id as string) when 'shared' then 'shared ' || cast(user_id as string)
         else 'Local pipeline' end as pipeline,
    case when src is not null then failed_stage end as failed_stage, 'failed' as status,
    case when src is not null and wk > 0 then '/logs/' || rid || '/baseline.log' end as baseline_id,
    case when src is not null then cast(n as string) end as rows from ({META})""")
oracle("meta_config_explode", f"""
    select '/logs/' || rid || '/run.log' as run_id, 'dependencies' as kind, 'lib_a' as key,
           '1.' || cast(min_k % 3 as string) as value from ({META}) where src is not null
    union all select '/logs/' || rid || '/run.log', 'environment', 'py', '3.11' from ({META})
      where src is not null and n % 2 = 0""")
oracle("baseline_link", "select run_id, baseline_id from pairs")
oracle("dbt_normalize", """select r.run_id, 'dbt' as platform, r.seq, case when status in ('error','fail','runtime error')
      then 'error' when status = 'warn' then 'warning' else 'info' end as severity,
    '[' || status || '] ' || unique_id || case when coalesce(message, '') <> '' then ': ' || message else '' end ||
      case when coalesce(failures, 0) <> 0 then ' (' || cast(failures as string) || ' failing rows)' else '' end as message,
    unique_id as source, 'models/' || s.s_name || '.sql' as code_path from (
      select 'inv-' || cast(p_partkey as string) as run_id, 0::bigint as seq,
        case when p_size % 5 = 0 then 'warn' else 'success' end as status,
        'model.s' || cast(p_partkey % 200 as string) as unique_id, null as message, null::int as failures from part
      union all select 'inv-' || cast(p_partkey as string), 1,
        case p_size % 4 when 0 then 'error' when 1 then 'runtime error' else 'success' end,
        'model.s' || cast((p_partkey + 7) % 200 as string), 'cannot be cast: ' || p_name, 0 from part
      union all select 'inv-' || cast(p_partkey as string), 2, case when p_size % 3 = 0 then 'fail' else 'pass' end,
        'test.not_null_' || p_brand, '', p_size % 6 from part) r
    left join supplier s on r.unique_id = 'model.s' || cast(s.s_suppkey as string)""")
oracle("dbt_scan", """select 'inv-' || cast(p_partkey as string) as run_id, 'dbt' as platform, 'dbt project' as pipeline,
    case when p_size % 4 in (0, 1) then 'model.s' || cast((p_partkey + 7) % 200 as string)
         when p_size % 3 = 0 then 'test.not_null_' || p_brand end as failed_stage,
    case when p_size % 4 in (0, 1) or p_size % 3 = 0 then 'failed' else 'success' end as status,
    '2024-01-01T00:00:00Z' as started_at from part""")
ORACLE["dbt_scan_events"] = ORACLE["dbt_normalize"]
oracle("gha_normalize", f"""select cast(o_orderkey as string) as run_id, 'github-actions' as platform,
    'data-pipeline' as pipeline, {FAIL_STEP} as failed_stage,
    case o_orderstatus when 'F' then 'failed' when 'O' then 'success' else 'unknown' end as status,
    strftime(o_orderdate, '%Y-%m-%d') as started_at, 'https://ci.example/' || cast(o_orderkey as string) as url,
    'b' || cast(o_custkey % 5 as string) as branch, 'sha' || cast(o_orderkey as string) as sha from orders""")
oracle("gha_log_events", """select cast(o_orderkey as string) as run_id, seq, severity, message, timestamp from (
    select o_orderkey, 0::bigint as seq, 'info' as severity, '2024-01-01T08:00:01Z ##[group]Run Load' as message, '2024-01-01T08:00:01Z' as timestamp from orders
    union all select o_orderkey, 1, 'info', '2024-01-01T08:00:02Z DEBUG using token ghp_ABCDEFGHIJKLMNOPQRSTUVWXYZ01', '2024-01-01T08:00:02Z' from orders
    union all select o_orderkey, 2, 'error', '2024-01-01T08:00:03Z Error: Input required and not supplied: S_' || cast(o_custkey as string), '2024-01-01T08:00:03Z' from orders where o_orderstatus = 'F'
    union all select o_orderkey, 3, 'info', '2024-01-01T08:00:03Z ##[error]Process completed with exit code 1.', '2024-01-01T08:00:03Z' from orders where o_orderstatus = 'F'
    union all select o_orderkey, 2, 'info', '2024-01-01T08:00:06Z ##[endgroup]', '2024-01-01T08:00:06Z' from orders where o_orderstatus <> 'F')""")
COMMITS = """select 'github' as platform, 'c' || cast(p_partkey as string) as id, 'commit' as kind,
    'ci: rename ' || p_name as title, 'ci: rename ' || p_name || chr(10) || 'size ' || cast(p_size as string) as summary,
    '2024-01-02' as timestamp, p_brand as author, p_partkey from part"""
oracle("gha_changes", f"select * exclude (p_partkey) from ({COMMITS})")
oracle("databricks_normalize", """select cast(o_orderkey as string) as run_id, 'databricks' as platform, seq, 'error' as severity, message,
    case when o_orderstatus = 'F' then 'silver_' || cast(o_custkey % 4 as string) end as source from (
    select *, 0::bigint as seq, '2024-01-01T08:00:12Z ERROR cannot resolve c' || cast(o_custkey as string) as message from orders where o_orderkey % 3 = 2
    union all select *, 1, '2024-01-01T08:00:12Z ERROR Task silver failed' from orders where o_orderkey % 3 = 2
    union all select *, 0, 'AnalysisException: cannot resolve c' || cast(o_custkey as string) from orders
      where o_orderkey % 3 <> 2 and o_orderstatus = 'F')""")
oracle("databricks_runs", """select cast(o_orderkey as string) as run_id, 'job ' || o_orderpriority as pipeline,
    case when o_orderstatus = 'F' then 'silver_' || cast(o_custkey % 4 as string) end as failed_stage,
    case when o_orderstatus = 'F' then 'failed' else 'success' end as status,
    strftime(o_orderdate, '%Y-%m-%d') as started_at, key, value from (
    select *, 'pandas' as key, '2.' || cast(o_custkey % 3 as string) as value from orders
    union all select *, 'spark_version', '14.' || cast(o_custkey % 3 as string) from orders
    union all select *, 'node_type', 'n' || cast(o_orderkey % 2 as string) from orders)""")
oracle("snowflake_normalize", f"""select run_id, 'snowflake' as platform, seq, severity, message, source, strftime(l_shipdate, '%Y-%m-%d') as timestamp from (
    select {QUERY_ID} as run_id, 0::bigint as seq, 'info' as severity, 'Query ' || {QUERY_ID} || ' on WH_' || cast(l_suppkey % 4 as string) ||
      ' (' || cast(l_partkey as string) || ' ms)' as message, null as source, l_shipdate from lineitem
    union all select {QUERY_ID}, 1, 'error', '000904: SQL compilation error: invalid identifier ' || chr(39) || 'C' || cast(l_partkey as string) || chr(39),
      {QUERY_ID}, l_shipdate from lineitem where l_returnflag = 'R' and l_linestatus = 'F')""")
oracle("snowflake_runs", f"""select {QUERY_ID} as run_id, 'snowflake' as platform, 'Snowflake query' as pipeline,
    case when l_returnflag = 'R' then 'failed' else 'success' end as status, strftime(l_shipdate, '%Y-%m-%d') as started_at,
    l_partkey as duration_ms, 'WH_' || cast(l_suppkey % 4 as string) as warehouse from lineitem""")
oracle("snowflake_configs", f"""select {QUERY_ID} as run_id, 'query' as kind, 'text' as key, 'SELECT c' || cast(l_partkey as string) as value from lineitem
    union all select {QUERY_ID}, 'query', 'warehouse', 'WH_' || cast(l_suppkey % 4 as string) from lineitem""")
oracle("snowflake_changes", """select 'snowflake' as platform, id, 'schema_change' as kind, title, summary, timestamp,
    null::varchar as author from ddl""")
oracle("mongo_normalize", f"""select run_id, 'mongodb' as platform, seq, severity, message, source from (
    select {OP_ID} as run_id, 0::bigint as seq, 'info' as severity, {OP} || ' on ' || {PLACE} || ' — plan ' ||
      case when l_returnflag = 'A' then 'COLLSCAN' else 'IXSCAN' end || ', ' || cast(l_partkey as string) || ' ms, examined ' ||
      cast(l_partkey as string) || ' / returned ' || cast(cast(l_quantity as bigint) - 1 as string) as message, null as source from lineitem
    union all select {OP_ID}, 1, 'error', {STORE_ERROR}, {PLACE} from lineitem where {STORE_ERROR} is not null)""")
oracle("mongo_runs", f"""select {OP_ID} as run_id, {PLACE} || ' ' || {OP} as pipeline,
    case when {STORE_ERROR} is not null then 'failed' else 'success' end as status, l_partkey as duration_ms from lineitem""")
oracle("issues_normalize", "select key as id, 'jira' as platform, key, title, status, url from issue_rows")
oracle("runs_list", f"""select cast(o_orderkey as string) as run_id, 'failed' as status, {FAIL_STEP} as failed_stage
    from orders where o_orderstatus = 'F'""")
oracle("run_get", f"""select run_id, platform, pipeline from runs where run_id in (
    select {A.RUN_ID} from raw where event_type = 'purchase' and wk = 0)""")
oracle("missing_runs", """select distinct cast(c_custkey as string) || '-w0' as run_id from customer
    where cast(c_custkey as string) || '-w0' not in (select run_id from runs)""")
oracle("changes_union", f"""select 0::bigint as source, p_partkey as pos, platform, id, kind, title from ({COMMITS})
    union all select 1, ord, 'snowflake', id, 'schema_change', title from ddl""")
oracle("incidents_json_sink", f"""select i.run_id, i.title, i.category, i.confidence, i.score,
    (select count(*) from hyp_off h where h.run_id = i.run_id) as n_hypotheses,
    (select count(*) from evidence_off e where e.run_id = i.run_id) as n_evidence,
    (select cast(sum({STEP_COUNT}) as bigint) from hyp_off h where h.run_id = i.run_id) as n_recommendations from inc_off i""")
oracle("sarif_findings", """select run_id, rank, category as rule_id, case confidence when 'high' then 'error'
    when 'medium' then 'warning' else 'note' end as level, title || ' — ' || rationale as text, code_path as uri,
    case when code_line <> 0 then code_line end as start_line from hyp_on""")
oracle("sarif_rules", "select run_id, category as rule_id, arg_max(title, rank) as name from hyp_on group by run_id, category")
oracle("diff_report_rows", """select run_id, cast(case section when 'parameters' then 1 when 'dependencies' then 2
      when 'configuration' then 3 else 4 end as bigint) as section_ord, section, lower(key) as sort_key, key, before, after from diffs
    union all select run_id, 5, 'new_errors', lpad(cast(n as string), 2, '0'), message, null, null from (
      select *, row_number() over (partition by run_id order by seq) as n from new_err) where n <= 10""")
oracle("evidence_stream", "select run_id, seq, '[' || cast(seq as string) || '] ' || message as line from meaningful")

# lines
oracle("parse_severity", "select run_id, seq, severity from parsed")
oracle("parse_timestamp", f"select run_id, seq, {group('line', fixed.TIMESTAMP, 1)} as timestamp from lines")
oracle("parse_code_ref", f"""select run_id, seq, {group('line', fixed.CODE_REF, 1)} as path,
    try_cast({group('line', fixed.CODE_REF, 2)} as bigint) as line, {group('line', fixed.CODE_REF, 3)} as symbol
    from lines where {match('line', fixed.CODE_REF)}""")
oracle("attach_frame", "select run_id, seq, severity, path, line, symbol from coded")

# redaction
for _query, _rule in {
    "redact_connection_string": "connection_string", "redact_aws_key": "aws_access_key_id",
    "redact_aws_secret": "aws_secret", "redact_github_token": "github_token",
    "redact_slack_token": "slack_token", "redact_jwt": "jwt", "redact_private_key": "private_key",
    "redact_auth_header": "authorization_header", "redact_secret_kv": "generic_secret_kv",
    "redact_email": "email",
}.items():
    oracle(_query, f"select doc_id, text, n_hits from ({redact(SECRET_SRC, 'text', ['doc_id'], only=_rule)})")
for _query, _level in (("redact_text", "strict"), ("redact_text_standard", "standard")):
    oracle(_query, "select doc_id, text, array_to_string(hits, ',') as hits, n_hits from "
                   f"({redact(SECRET_SRC, 'text', ['doc_id'], _level)})")
oracle("redact_log_events", "select run_id, seq, message, n_hits > 0 as redacted, n_hits from redacted")
oracle("redaction_counts", "select run_id, hit_count from hit_counts")
oracle("mask_fields", f"""select doc_id, 'Password' as key, '«REDACTED»' as value from documents
    union all select doc_id, 'region', {redact_scalar('source')} from documents
    union all select doc_id, 'note', {redact_scalar('text')} from {SECRET_SRC}""")
oracle("injection_scan", f"""select conv_id, turn, len(m) > 0 as suspicious, coalesce(array_to_string(m, '|'), '') as markers
    from (select *, {MARKER_LIST} as m from {UNTRUSTED_SRC})""")
oracle("untrusted_neutralize", f"""select conv_id, turn, text, len({MARKER_LIST}) > 0 as suspicious
    from (select conv_id, turn, {NEUTRAL} as text from {UNTRUSTED_SRC})""")

# deduplication
oracle("normalize_template", "select run_id, seq, template from errs")
oracle("is_cascade", f"select run_id, seq, {cascade('message')} as cascade from errs")
oracle("dedup_errors", "select run_id, seq, severity, message, template, n_events from meaningful")
oracle("dedup_fallback", "select run_id, seq, message from meaningful where not has_cause")
oracle("dedup_counters", "select run_id, errors, templates, removed_duplicates, removed_cascades from counters")

# earliest failure, signatures, classification
oracle("earliest_failure", """select run_id, earliest_seq, earliest_message, earliest_source, reason, match_title, token
    from earliest""")
oracle("signature_match", "select run_id, seq, sig_ord, signature, category, weight from hits")
USER_VALUES = ", ".join(
    f"({i}, {q(name)}, {q(token)}, {q(re2(before + token + '([0-9]+)' + after))})"
    for i, (name, before, token, after) in enumerate(A.USER_KINDS))
oracle("signature_match_many", f"""select run_id, seq, cast(kind * {A.USER_NUMBERS} + n as bigint) as sig_ord,
    'user.' || name || '.' || n as signature, 'user.' || name as category, cast(40 + n % 50 as bigint) as weight,
    name || ': ' || token || n as title, token || n as token
    from (select run_id, seq, kind, name, token, try_cast(regexp_extract(message, pattern, 1) as bigint) as n
          from meaningful, (values {USER_VALUES}) as v(kind, name, token, pattern)) where n < {A.USER_NUMBERS}""")
oracle("signature_title", "select run_id, seq, signature, title from hits")
oracle("signature_token", "select run_id, seq, signature, token, code_path, code_line from hits")
oracle("classify_by_category", "select run_id, rank, category, weight, matches from categories")
oracle("classify_primary", "select run_id, category, class_score as score from classified")

# comparison
oracle("diff_records", "select run_id, section, key, before, after from diffs")
for _query, _section in (("diff_parameters", "parameters"), ("diff_dependencies", "dependencies"),
                         ("diff_environment", "environment"), ("diff_config", "configuration")):
    oracle(_query, f"select run_id, key, before, after from diffs where section = '{_section}'")
oracle("new_errors", "select run_id, seq, message from new_err")

# correlation
oracle("change_correlate", "select run_id, token, change_id, change_kind, change_title, predates from change_hits")
oracle("tokenize", f"select doc_id, unnest({tokens('text')}) as token from documents")
oracle("jaccard_similarity", f"""select a.conv_id, a.turn, {jaccard('a.t', 'b.t')} as similarity from
    (select conv_id, turn, {tokens('text')} as t from conversations) a join
    (select conv_id, turn, {tokens('text')} as t from conversations) b on a.conv_id = b.conv_id and a.turn = b.turn + 1""")
oracle("incident_seed", "select run_id, token from seeds")
oracle("similar_incidents", "select run_id, issue_key, similarity from related")
oracle("related_issues", """select * from (select r.run_id, count(*) over (partition by r.run_id) as n_related,
    row_number() over (partition by r.run_id order by r.similarity desc, i.ord) as rank, r.issue_key, r.similarity
    from related r join issue_rows i on i.key = r.issue_key) where rank <= 3""")
oracle("issue_search", "select key, title, status from issue_rows where status = 'Done' and contains(lower(title), 'gear')")

# hypotheses
oracle("score_primary", """select run_id, category, class_score, change_id is not null as has_change, changed_dependencies,
    related_issues, raw_score from scored_on""")
SCORE = "least(1.0, weight / 100.0::double / 1.6::double)"
oracle("confidence_bucket", f"select run_id, category, round({SCORE}, 3) as score, {confidence(SCORE)} as confidence from categories")
EVIDENCE_COLS = f"run_id, category, {EV}, kind, statement"
oracle("evidence_confirmed", f"select {EVIDENCE_COLS} from evidence_off where kind = 'confirmed'")
oracle("evidence_change", f"""select {EVIDENCE_COLS} from (
    select b.run_id, b.category, case when c.change_id is not null then 'e-change' || c.change_id else 'e-token' || b.token end as seed,
      case when c.change_id is not null then 'strong_correlation' else 'inference' end as kind,
      case when c.change_id is not null then c.change_kind || ' "' || c.change_title || '" references "' || b.token || '" and predates the failed run.'
           else 'Failure centers on "' || b.token || '"; no correlated change was found in connected systems.' end as statement
    from base b left join change_hits c on c.run_id = b.run_id where b.token is not null)""")
oracle("evidence_dependency", f"select {EVIDENCE_COLS} from evidence_off where seed like 'e-dep%'")
oracle("evidence_parameter", f"select {EVIDENCE_COLS} from evidence_off where seed like 'e-param%'")
oracle("evidence_no_baseline", f"select {EVIDENCE_COLS} from evidence_off where kind = 'missing_information'")
oracle("evidence_issue", f"""select {EVIDENCE_COLS} from (
    select r.run_id, b.category, 'e-issue' || r.issue_key as seed, 'inference' as kind,
      'Similar prior incident ' || r.issue_key || ': "' || i.title || '" (similarity ' || cast(cast(floor(r.similarity * 100) as bigint) as string) || '%).' as statement,
      row_number() over (partition by r.run_id order by r.similarity desc, i.ord) as n
    from related r join issue_rows i on i.key = r.issue_key join base b on b.run_id = r.run_id) where n <= 3""")
oracle("evidence_issue_all", """select r.run_id, 'Similar prior incident ' || r.issue_key || ': "' || i.title || '" (similarity '
      || cast(cast(floor(r.similarity * 100) as bigint) as string) || '%).' as statement, i.url, 'jira' as ref_platform, r.issue_key as ref_id,
    row_number() over (partition by r.run_id order by r.similarity desc, i.ord) as n
    from related r join issue_rows i on i.key = r.issue_key""")
oracle("evidence_references", """select run_id, 'confirmed' as kind, code_path, code_line, null::varchar as ref_platform, null::varchar as ref_id
      from base where earliest_seq is not null and code_path is not null
    union all select run_id, 'strong_correlation', null, null, 'snowflake', replace(change_id, 'ddl-', 'raw.') from (
      select c.run_id, d.object as change_id from change_hits c join (select 'ddl-' || cast(p_partkey as string) as id, 'raw.' || p_brand as object from part) d
      on d.id = c.change_id)""")
oracle("hypotheses_all", f"""select run_id, hypothesis_id, category, title, rationale, confidence, score from (
    select run_id, hypothesis_id, category, title, rationale, confidence, score, ord from hyp_on where ord = 0
    union all select c.run_id, {short_id("'h-alt' || c.category")}, c.category, {label('c.category')},
      'Secondary signal: ' || cast(c.matches as string) || ' matching signature(s) for ' || {label('c.category')} || '.',
      {confidence('least(0.6, c.weight / 100.0::double / 2.0::double)')}, round(least(0.6, c.weight / 100.0::double / 2.0::double), 3), 1
    from categories c where c.rank > 1 and least(0.6, c.weight / 100.0::double / 2.0::double) >= 0.25)""")
oracle("result_json_sink", """select 'incidents' as dataset, run_id, 1::bigint as n from runs
    union all select 'diff', run_id, count(*) from diffs group by run_id
    union all select 'errors', run_id, count(*) from meaningful group by run_id
    union all select 'related_issues', run_id, count(*) from related group by run_id
    union all select 'changes', run_id, count(*) from change_hits group by run_id""")
HYP_COLS = "run_id, hypothesis_id, category, title, rationale, confidence, score"
oracle("hypothesis_primary", f"select {HYP_COLS} from hyp_on where ord = 0")
oracle("hypothesis_alternates", f"select {HYP_COLS} from hyp_off where ord > 0")
oracle("hypothesis_rank", "select run_id, rank, category, score from hyp_on")
oracle("recommendations", f"""select h.run_id, h.category, k.ord, k.kind, k.description, k.mutates,
    {short_id("substr(k.kind, 1, 1) || k.description")} as recommendation_id
    from hyp_off h join knowledge k on k.category = h.category""")
oracle("short_id", f"select doc_id, {short_id('''('inc' || substr(text, 1, 40))''')} as id from documents")
oracle("category_labels", f"""select coalesce(c.category, 'unknown') as category, count(*) as runs, {label("coalesce(c.category, 'unknown')")} as label
    from classified c group by all""")

# assembly
oracle("investigate_runs", """select run_id, incident_id, title, platform, pipeline, failed_stage, category, confidence, score,
    summary, status, coalesce(array_to_string(notes, '|'), '') as notes, meaningful, related_issues, reason, token, predates from inc_on""")
_NONE = "null::varchar as mode, null::bigint as n, null::bigint as user_id, null::bigint as wk, null::bigint as min_k, null::bigint as max_k"
_PLATFORM_RUNS = f"""select 'github-actions/' || cast(o_orderkey as string) as run_id, 'github-actions' as platform, 'data-pipeline' as pipeline,
      {FAIL_STEP} as failed_stage, strftime(o_orderdate, '%Y-%m-%d') as started_at from orders
    union all select 'databricks/' || run_id, 'databricks', pipeline, failed_stage, started_at from (
      select distinct run_id, pipeline, failed_stage, started_at from ({ORACLE["databricks_runs"]}))
    union all select 'dbt/' || run_id, platform, pipeline, failed_stage, started_at from ({ORACLE["dbt_scan"]})"""
_PLATFORM_EVENTS = f"""select 'github-actions/' || run_id as run_id, 'github-actions' as platform, seq, null as source, severity, message from ({ORACLE["gha_log_events"]})
    union all select 'databricks/' || run_id, platform, seq, source, severity, message from ({ORACLE["databricks_normalize"]})
    union all select 'dbt/' || run_id, platform, seq, source, severity, message from ({ORACLE["dbt_normalize"]})"""
ORACLE["investigate_platforms"] = sql(
    """select platform, substr(run_id, length(platform) + 2) as run_id, platform || ':' || substr(run_id, length(platform) + 2) as incident_key,
    title, pipeline, failed_stage, category, confidence, score, summary, status, meaningful, related_issues, reason, token, predates from inc_on""",
    runs=f"select *, null::varchar as baseline_id, {_NONE} from ({_PLATFORM_RUNS})",
    parsed=f"select *, null::timestamp as ts, message as line from ({_PLATFORM_EVENTS})",
    coded="select run_id, seq, severity, null::varchar as path, null::bigint as line, null::varchar as symbol from parsed",
    ddl=f"""select p_partkey as ord, id, title, summary, timestamp from ({COMMITS})
      union all select 1000000000 + p_partkey, 'ddl-' || cast(p_partkey as string), 'RENAME COLUMN col_' || cast(p_size as string), p_name,
      '2024-01-' || lpad(cast(1 + p_partkey % 28 as string), 2, '0') || ' 00:00:00' from part""")
oracle("incident_build", """select run_id, incident_id, title, platform, pipeline, failed_stage, category, confidence, summary
    from inc_off""")
oracle("investigation_status", "select run_id, status, meaningful from inc_off")
oracle("investigation_notes", "select run_id, unnest(notes) as note from inc_off")
oracle("fail_gate", "select run_id, confidence, score from inc_off where confidence in ('high', 'medium')")
oracle("correlate_switch", "select run_id, category, confidence, score, related_issues from inc_off")

# streaming and trend
oracle("watch_triage", f"""select run_id, seq, severity, message, coalesce(b.category, 'unknown') as category, b.title from (
    select *, list_extract(list_sort(list_transform(list_filter({signature_structs()}, lambda x: x is not null),
      lambda x: {{'o': -x.weight, 's': x.sig_ord, 'category': x.category, 'title': x.title}})), 1) as b
    from (select *, null::varchar as code_path, null::bigint as code_line from errs))""")
oracle("watch_dedup", """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, platform, run_id, template, any_value(severity) as severity,
    min(seq) as seq, count(*) as n_events from errs group by date_trunc('day', ts), platform, run_id, template""")
oracle("watch_error_counts", """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, platform, run_id, template, min(seq) as seq, count(*) as n_events
    from errs group by all""")
oracle("watch_category_counts", f"""select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, category, count(*) as failures from (
    select ts, coalesce(list_extract(list_sort(list_transform(list_filter({signature_structs()}, lambda x: x is not null),
      lambda x: {{'o': -x.weight, 's': x.sig_ord, 'category': x.category}})), 1).category, 'unknown') as category
    from (select *, null::varchar as code_path, null::bigint as code_line from errs)) group by all""")
oracle("metric_regression", f"""select pipeline, period, value, history, round(z, 6) as z_score, coalesce(abs(z) >= 1.5, false) as outlier from (
    select *, case when sd > 0 then (value - m) / sd end as z from (
    select pipeline, period, value, count(value) over w as history, avg(value) over w as m, stddev_samp(value) over w as sd
    from (select {A.PIPELINE} as pipeline, strftime(ts, '%Y-%m-%d') as period, count(*)::double as value from raw group by all)
    window w as (partition by pipeline order by period rows between 7 preceding and 1 preceding)))""")
