"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import re

from quillspan.llm import credentials, repair
from quillspan.llm.decontam import MAYBE, NAME, NUM, POINT, UNIT, UNITS, LeakPlan


def leak_sql(plan: LeakPlan = LeakPlan()) -> str:
    """The rows of op10: tokens, windows and slots in lists and joins. Every window of a document meets those of the items; there are no probes and no hashes.

    Patterns here have no look-around: one takes the characters beside its match and puts them back. Where matches share such a
    character the pattern is applied twice.
    """
    letters = r"\p{L}\p{M}"
    words = "|".join(sorted(u for u in UNITS if u != "%"))
    gaps = rf"[^{letters}\p{{N}}{NAME}-{UNIT}{POINT}]+"
    x = f"translate(coalesce(text, ''), '{NAME}{NUM}{UNIT}{MAYBE}{POINT}', '')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '([{letters}\p{{N}},;)]) (\p{{Lu}}\p{{Ll}})', '\1 {NAME}\2', 'g')"
    marked = rf"lower(regexp_replace({x}, '(^|[^{letters}\p{{N}}{NAME}])(\p{{Lu}}\p{{Ll}})', '\1{MAYBE}\2', 'g'))"
    inside = rf"regexp_extract_all(marked, '{NAME}([{letters}]+)', 1)"
    lowered = rf"string_split_regex(marked, '[^{letters}\p{{N}}{NAME}{MAYBE}]+')"
    names = f"array_to_string(list_filter(list_distinct({inside}), lambda n: NOT list_contains({lowered}, n)), '|')"
    y = rf"translate(regexp_replace(marked, '{MAYBE}(' || {names} || ')($|[^{letters}])', '{NAME}\1\2', 'g'), '{MAYBE}', '')"
    for _ in range(2):
        y = rf"regexp_replace({y}, '([0-9])[.,]([0-9])', '\1{POINT}\2', 'g')"
    y = rf"regexp_replace({y}, '[0-9{POINT}]+', ' {NUM}\0 ', 'g')"
    y = rf"regexp_replace({y}, '({NUM}[0-9{POINT}]* +)(?:(%)|({words})($|[^\p{{L}}\p{{N}}]))', '\1 {UNIT}\2\3 \4', 'g')"
    slots = f"('{NAME}', '{NUM}', '{UNIT}')"
    joined = lambda of, at, size: f"array_to_string({of}[{at} + 1:{at} + {size}], chr(31))"
    return f"""
WITH texts AS (
  SELECT DISTINCT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'i', item_id, text FROM benchmark WHERE item_id IS NOT NULL
), marks AS (
  SELECT side, id, text, {marked} AS marked FROM texts
), written AS (
  SELECT side, id, text, list_filter(string_split_regex({y}, '{gaps}'), lambda t: t <> '') AS s FROM marks
), typed AS (
  SELECT *, list_transform(s, lambda t: CASE WHEN t[1] IN {slots} THEN t[1] ELSE t END) AS t, len(s) AS n, row_number() OVER () AS rid FROM written
), ways AS (
  SELECT id AS item_id, n AS n_item, s AS isf, t AS it FROM typed WHERE side = 'i'
  UNION ALL SELECT id, n, list_concat(['{NAME}' || s[1]], s[2:]), list_concat(['{NAME}'], t[2:]) FROM typed WHERE side = 'i' AND regexp_matches(t[1], '^\\p{{L}}')
), sized AS (
  SELECT *, CASE WHEN n_item >= {plan.whole_below} THEN {plan.window} ELSE n_item END AS size FROM ways
), placed AS (
  SELECT *, unnest(range(0, n_item - size + 1)) AS iat FROM sized WHERE size >= {plan.min_literals}
), telling AS (
  SELECT * FROM placed WHERE len(list_filter(it[iat + 1:iat + size], lambda x: x NOT IN {slots})) >= {plan.min_literals}
), items AS (
  SELECT item_id, n_item, size, isf, it, iat, {joined("it", "iat", "size")} AS w FROM telling
  UNION SELECT item_id, n_item, size, isf, isf, iat, {joined("isf", "iat", "size")} FROM placed ANTI JOIN telling USING (item_id)
), spread AS (
  SELECT rid, id AS doc_id, size, unnest(list_transform(range(0, n - size + 1), lambda i: {{'dat': i, 'w': {joined("t", "i", "size")}, 's': {joined("s", "i", "size")}}})) AS v
  FROM typed, (SELECT DISTINCT size FROM items) WHERE side = 'd'
), looked AS (
  SELECT rid, doc_id, size, v.dat AS dat, v.w AS w FROM spread WHERE v.w IN (SELECT w FROM items)
  UNION SELECT rid, doc_id, size, v.dat, v.s FROM spread WHERE v.s IN (SELECT w FROM items)
), met AS (
  SELECT doc_id, text, item_id, n_item, dat - iat AS diag, iat, dat, size, it, isf, s
  FROM looked JOIN items USING (w, size) JOIN (SELECT rid, text, s FROM typed) USING (rid)
), offsets AS (
  SELECT *, unnest(range(1, size + 1)) AS k FROM met
), cells AS (
  SELECT DISTINCT doc_id, text, item_id, n_item, diag, iat + k AS p, it[iat + k] AS t, isf[iat + k] AS a, s[dat + k] AS b, it[iat + k] IN {slots} AS slot FROM offsets
), values_of AS (
  SELECT DISTINCT doc_id, text, item_id, n_item, diag, t, a, b FROM cells WHERE slot
), loose AS (
  SELECT *, a <> b AND (count(*) OVER (PARTITION BY doc_id, text, item_id, n_item, diag, t, a) > 1 OR count(*) OVER (PARTITION BY doc_id, text, item_id, n_item, diag, t, b) > 1) AS clash FROM values_of
), judged AS (
  SELECT c.*, coalesce(l.clash, false) AS clash FROM cells c LEFT JOIN loose l USING (doc_id, text, item_id, n_item, diag, t, a, b)
), stretches AS (
  SELECT *, sum(clash::INT) OVER (PARTITION BY doc_id, text, item_id, n_item, diag ORDER BY p) AS stretch FROM judged
), runs AS (
  SELECT doc_id, text, item_id, n_item, diag, stretch, count(*) AS n_tokens, count(DISTINCT CASE WHEN slot THEN t || chr(31) || a END) AS n_slots FROM stretches WHERE NOT clash GROUP BY ALL
), good AS (
  SELECT * FROM runs WHERE n_tokens >= least({plan.min_run}, n_item)
)
SELECT doc_id, item_id, n_tokens::BIGINT AS n_tokens, n_slots::BIGINT AS n_slots FROM good
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_tokens DESC, n_slots DESC) = 1
"""


def credential_sql(plan: credentials.LinkPlan = credentials.LinkPlan()) -> str:
    """The rows of op12. A text is cut at the matches of a kind; the lengths of cuts and matches before one are its place."""
    least = credentials.LEAST
    # either case of ASCII's letters only: without regard to case, RE2 takes others for s and k too
    cased = lambda m: "(?:" + re.sub("[a-z]", lambda x: f"[{x[0]}{x[0].upper()}]", m[1]) + ")"
    one = lambda pattern: "'" + re.sub(r"\(\?i:([^)]*)\)", cased, pattern).replace("'", "''") + "'"
    patterns = {
        "assign": credentials.ASSIGN, "access": credentials.ACCESS.replace("+", f"{{{least['access'] - 4},}}"), "hex": credentials.HEX.replace("+", f"{{{least['hex']},}}"),
        "identifier": credentials.IDENTIFIER, "endpoint": credentials.ENDPOINT, "phrase": credentials.PHRASE.removesuffix("+") + f"{{{least['phrase']},}}",
    }
    cuts = " UNION ALL ".join(f"SELECT rid, '{k}' AS kind, {n} AS ord, regexp_extract_all(text, {one(p)}) AS m, string_split_regex(text, {one(p)}) AS g FROM texts WHERE regexp_matches(text, {one(p)})" for n, (k, p) in enumerate(patterns.items()))
    near = f"(y.s >= x.e AND y.s - x.e <= {plan.reach} AND NOT regexp_matches(substr(text, x.e + 1, y.s - x.e), {one(credentials.BLANK_LINE)}) OR y.e <= x.s AND x.s - y.e <= {plan.reach} AND NOT regexp_matches(substr(text, y.e + 1, x.s - y.e), {one(credentials.BLANK_LINE)}))"
    fits = " OR ".join(f"x.role = '{role}' AND y.role IN ({', '.join(map(one, others))})" for role, others in credentials.COMPLETES.items())
    role = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in credentials.ROLE.items())
    told = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord)"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), cuts AS ({cuts}
), found AS (
  SELECT rid, kind, ord, m[i] AS t, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cuts)
), spans AS (
  SELECT rid, kind, ord, s, s + length(t) AS e, CASE kind {role} END AS role FROM found
  WHERE kind NOT IN ('assign', 'phrase') OR kind = 'assign' AND length(regexp_extract(t, {one(credentials.ASSIGN)}, 1)) >= {least["assign"]}
    OR kind = 'phrase' AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]')
), base AS (
  SELECT * FROM spans WHERE ord < 3
), named AS (
  SELECT * FROM spans x WHERE kind IN ('identifier', 'endpoint') AND NOT EXISTS (SELECT 1 FROM base y WHERE y.rid = x.rid AND y.s < x.e AND x.s < y.e)
), words AS (
  SELECT * FROM spans x WHERE kind = 'phrase' AND NOT EXISTS (SELECT 1 FROM (FROM base UNION ALL FROM named) y WHERE y.rid = x.rid AND y.s < x.e AND x.s < y.e)
), parts AS (
  FROM base UNION ALL FROM named UNION ALL FROM words
), linked AS (
  SELECT DISTINCT x.rid, x.ord, x.s FROM parts x JOIN parts y ON y.rid = x.rid AND ({fits}) JOIN texts t ON t.rid = x.rid WHERE {near}
), told AS (
  SELECT p.*, l.rid IS NOT NULL AS joined FROM parts p LEFT JOIN linked l USING (rid, ord, s) WHERE l.rid IS NOT NULL OR ord < 3
), sums AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in credentials.BASE)}, {told} FILTER (ord < 3) AS base, {told} AS spans, count(*) FILTER (joined) AS n_linked FROM told GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in credentials.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM texts LEFT JOIN sums USING (rid)
"""


def repair_sql(plan: repair.RepairPlan = repair.RepairPlan()) -> str:
    """The rows of op13, by costs from the front only: for each state the least (cost, audit, told) of all edits so far, a row a step."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    shown = lambda x: f"coalesce({x}::VARCHAR, ' ')"
    far = f"{{'c': {repair.FAR}, 'a': '', 't': NULL::VARCHAR[]}}"
    add = lambda q, w, letter, turn: f"{{'c': {q}.c + {w}, 'a': {q}.a || '{letter}', 't': list_append({q}.t, {turn})}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    both = lambda q: f"{{'c': {q}.c + {2 * plan.insert}, 'a': {q}.a || 'II', 't': list_concat({q}.t, ['user:', 'assistant:'])}}"
    closed_u = least("u", *(add(q, plan.insert, "I", "'user:'") for q in "bsa"))
    closed_a = least("a", add("u", plan.insert, "I", "'assistant:'"), *(both(q) for q in "bs"))
    turn = "role || ':' || text"
    rerole = lambda q, to: add(q, f"{plan.rerole} + late", "R", f"'{to}:' || text")
    keep = lambda q: add(q, "late", "K", turn)
    drop = lambda q: f"{{'c': {q}.c + {plan.delete}, 'a': {q}.a || 'D', 't': {q}.t}}"
    may = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE {far} END"
    to_u = [x for q in "bsa" for x in (may("fine AND initial = 'u'", keep(q)), may("fine", rerole(q, "user")))]
    return f"""
WITH RECURSIVE codes AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END)) AS code
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {shown("conv_id")} || ':' || {shown("turn")} AS key FROM conversations
), hashed AS (
  SELECT k.*, xor(list_reduce(list_concat([{0xFFFFFFFF}], list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)), lambda c, x: xor(c >> 8, code[(xor(c, x) & 255) + 1])), {0xFFFFFFFF}) % 20 AS h FROM keyed k, codes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hashed, range(CASE WHEN h = 3 THEN 2 ELSE 1 END) WHERE h <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, right(rtrim(text, {blank}), 1) AS final, left(role, 1) AS initial FROM damaged
), rows AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed
), steps AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS b, {far} AS s, {far} AS u, {far} AS a FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL
  SELECT conv_id, i, {drop("b")} AS b, {least(drop("s"), may("fine AND initial = 's'", keep("b")))} AS s, {least(drop("u"), *to_u)} AS u,
    {least(drop("a"), may("fine AND initial = 'a'", keep("u")), may("fine", rerole("u", "assistant")))} AS a
  FROM (SELECT p.conv_id, r.i, b, s, {closed_u} AS u, {closed_a} AS a, r.role, r.text, r.initial, r.fault NOT IN ('blank', 'duplicate') AS fine, (r.fault = 'truncated')::BIGINT * {plan.truncated} AS late
    FROM steps p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)
), ends AS (
  SELECT conv_id, {least("b", closed_a)} AS best FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, {", ".join(f"count(*) FILTER (fault = '{f}') AS {f}" for f in ("blank", "duplicate", "truncated"))},
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id
)
SELECT o.conv_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE_SQL = {"op10_decontamination": leak_sql(), "op12_credentials": credential_sql(), "op13_conversation_repair": repair_sql()}
