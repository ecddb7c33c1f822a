"""The registered queries in DuckDB SQL."""

from __future__ import annotations

import re
from html.entities import html5

from quillspan.functions import entities
from quillspan.functions.tabular import TRAILERS
from quillspan.functions.textcols import SPACES
from quillspan.operators.universe import FIXTURE

_LINES = "list_filter(list_transform(string_split({0}, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(13))), lambda l: l <> '')"
CLEAN = f"""SELECT doc_id, array_to_string(list_filter({_LINES.format('text')}, lambda l: length(l) - length(replace(l, '|', '')) <= 2
  AND (length(l) >= 15 OR right(l, 1) IN ('.', '!', '?', '"', ''''))), chr(10)) AS cleaned FROM documents"""

_B = _LINES.format("b")
_JOINED = f"array_to_string({_B}, ' ')"
_SENT = f"list_filter(list_transform(string_split(regexp_replace({_JOINED}, '([.!?])\\s+([A-Z\"“])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_GROUPED = f"CASE WHEN len({_SENT}) <= 3 THEN [{_JOINED}] ELSE list_transform(range(0, len({_SENT}), 3), lambda i: array_to_string(list_slice({_SENT}, i + 1, i + 3), ' ')) END"
_BLOCK = f"CASE WHEN len({_B}) < 2 THEN {_B} WHEN list_sum(list_transform({_B}, lambda l: length(l))) / len({_B}) < 80 THEN {_GROUPED} ELSE {_B} END"
_ART = f"""blocks AS (SELECT doc_id, i, string_split(text, chr(10) || chr(10))[i] AS b FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) AS i FROM documents)),
paras AS (SELECT doc_id, list_transform(list_filter(flatten(list({_BLOCK} ORDER BY i)), lambda p: length(p) >= 30), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))) AS ps FROM blocks GROUP BY doc_id),
art AS (SELECT d.doc_id AS article_id, source, string_split(text, chr(10))[1] AS headline,
  CASE WHEN len(ps) > 0 THEN ps WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN [] ELSE [trim(regexp_replace(text, '\\s+', ' ', 'g'))] END AS paragraphs,
  list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN length(text) - length(replace(text, '|', '')) > 10 THEN 'pipe_table' END], lambda x: x IS NOT NULL) AS reasons FROM documents d JOIN paras USING (doc_id))"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pattern(keywords: list[str]) -> str:
    return "(?i)(^|[^A-Za-z0-9])(" + "|".join(map(re.escape, keywords)) + ")($|[^A-Za-z0-9])"


_GROUPS = "groups(group_key, name, asset_class, pattern, member_names, assets) AS (VALUES " + ", ".join(
    f"({_quoted(k)}, {_quoted(g['name'])}, {_quoted(g['asset_class'])}, {_quoted(_pattern(g['keywords']))}, [{', '.join(_quoted(m['name']) for m in g['members'])}], [{', '.join(_quoted(m['name'] + '/' + m['ticker_symbol']) for m in g['members'])}])" for k, g in sorted(FIXTURE.items())
) + ")"
_OPEN = f"""{_ART}, {_GROUPS}, opened AS (SELECT *, headline || chr(10) || array_to_string(paragraphs, chr(10)) AS gate_text FROM art WHERE len(reasons) = 0),
dim AS (SELECT * FROM groups WHERE asset_class <> 'US equity sector'), fired AS (SELECT a.*, g.* FROM opened a JOIN dim g ON regexp_matches(a.gate_text, g.pattern))"""
_TASKS = f"""{_OPEN}, scored AS (SELECT *, list_filter(range(0, len(paragraphs)), lambda i: regexp_matches(paragraphs[i + 1], pattern)) AS evidence FROM fired),
tasks AS (SELECT *, len(evidence) / greatest(len(paragraphs), 1) AS relevance_score, len(evidence) > 0 AS relevant FROM scored)"""
SPLIT = f"WITH {_ART} SELECT article_id, len(paragraphs) AS n_paragraphs, sha256(array_to_string(paragraphs, chr(10) || chr(10))) AS digest FROM art"
STATS = f"""WITH {_ART} SELECT source, count(*) AS n_articles, sum(len(paragraphs))::BIGINT AS n_paragraphs, sum(coalesce(list_sum(list_transform(paragraphs, lambda p: length(p))), 0))::BIGINT AS n_chars,
  max(len(paragraphs)) AS most FROM art GROUP BY source"""
FIRES = f"WITH {_OPEN} SELECT a.article_id, coalesce(string_agg(f.group_key, ',' ORDER BY f.group_key), '') AS groups FROM opened a LEFT JOIN fired f USING (article_id) GROUP BY 1"
GATE_STATS = f"""WITH {_OPEN}, c AS (SELECT (SELECT count(*) FROM fired) AS calls_made, (SELECT count(*) FROM opened) * (SELECT count(*) FROM dim) AS n)
SELECT calls_made, n - calls_made AS calls_skipped, CASE WHEN n > 0 THEN 100.0::DOUBLE * (n - calls_made) / n ELSE 0.0 END AS calls_saved_pct FROM c"""
UNGATED = f"WITH {_OPEN} SELECT asset_class, group_key, count(*) AS n_tasks, sum(article_id)::BIGINT AS sum_ids FROM opened CROSS JOIN dim GROUP BY 1, 2"
_PROMPT = "'[HEADLINE] ' || headline || chr(10) || chr(10) || '[ARTICLE]' || chr(10) || array_to_string(list_transform(paragraphs, lambda p, i: '[' || (i - 1) || '] ' || p), chr(10) || chr(10)) || chr(10) || '[/ARTICLE]' || chr(10) || chr(10) || '[ASSET_GROUP] ' || name || ' | ' || asset_class || ' — constituents: ' || array_to_string(member_names, ', ')"
PROMPT = f"WITH {_OPEN}, p AS (SELECT article_id, group_key, {_PROMPT} AS prompt FROM fired) SELECT article_id, group_key, length(prompt) AS n_chars, sha256(prompt) AS digest FROM p"
REASONS = f"WITH {_ART} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM art) GROUP BY 1"
STUB = f"WITH {_TASKS} SELECT article_id, group_key, array_to_string(evidence, ',') AS evidence, relevance_score, relevant FROM tasks"
RECORDS = f"""WITH {_TASKS}, r AS (SELECT article_id, string_agg(name, ',' ORDER BY group_key) AS groups, array_to_string(flatten(list(assets ORDER BY group_key)), ',') AS assets,
  string_agg(group_key || ':' || asset_class || ':' || array_to_string(evidence, '+'), ';' ORDER BY group_key) AS mappings, array_to_string(list_sort(list_distinct(flatten(list(evidence)))), ',') AS evidence FROM tasks WHERE relevant GROUP BY 1)
SELECT a.article_id, a.headline, array_to_string(a.reasons, ',') AS reasons, coalesce(r.groups, '') AS groups, coalesce(r.assets, '') AS assets, coalesce(r.mappings, '') AS mappings, coalesce(r.evidence, '') AS evidence FROM art a LEFT JOIN r USING (article_id)"""
ROLLUP = f"""WITH {_TASKS}, k AS (SELECT * FROM tasks WHERE relevant) SELECT 'asset_class' AS dimension, asset_class AS key, count(*) AS n FROM k GROUP BY 2
UNION ALL SELECT 'group', name, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'reason', reason, count(*) FROM (SELECT unnest(reasons) AS reason FROM art) GROUP BY 2"""
TOTALS = f"""WITH {_TASKS} SELECT (SELECT count(*) FROM art) AS total_articles, (SELECT count(*) FROM art WHERE len(reasons) > 0) AS filtered_articles, (SELECT count(*) FROM tasks WHERE relevant) AS total_mappings"""
EVIDENCE = f"WITH {_TASKS}, e AS (SELECT DISTINCT article_id, paragraphs, i FROM (SELECT article_id, paragraphs, unnest(evidence) AS i FROM tasks WHERE relevant)) SELECT article_id, i::VARCHAR AS paragraph, paragraphs[i + 1] AS text FROM e"
_GRADED = f"""{_TASKS}, src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, toxic DESC) AS rn FROM labels) WHERE rn = 1),
graded AS (SELECT t.*, s.quality, s.toxic, CASE WHEN s.doc_id IS NULL THEN 'article_not_in_source' WHEN k.name IS NULL THEN 'group_not_in_universe' END AS skip_reason
  FROM (SELECT * FROM tasks WHERE relevant) t LEFT JOIN src s ON s.doc_id = t.article_id LEFT JOIN (SELECT name FROM groups WHERE group_key <> 'spanish') k ON k.name = t.name),
v AS (SELECT *, CASE WHEN toxic = 1 THEN 'incorrect' ELSE 'correct' END AS verdict, CASE WHEN quality = 1 THEN relevance_score ELSE relevance_score / 2 END AS grader_score FROM graded WHERE skip_reason IS NULL),
w AS (SELECT *, CASE WHEN verdict = 'correct' THEN abs(relevance_score - grader_score) > 0.40::DOUBLE ELSE abs(relevance_score - grader_score) < 0.15::DOUBLE END AS self_inconsistent FROM v)"""
_CITED = "array_to_string(list_transform(paragraphs, lambda p, i: '[' || (i - 1) || '] ' || p), chr(10) || chr(10))"
MESSAGE = f"""WITH {_GRADED} SELECT article_id, name AS group_name, '[HEADLINE] ' || headline || chr(10) || chr(10) || '[ARTICLE]' || chr(10) || {_CITED} || chr(10) || '[/ARTICLE]' || chr(10) || chr(10)
  || '[MAPPER_CLAIM]' || chr(10) || 'Asset group: ' || name || chr(10) || 'Asset class: ' || asset_class || chr(10) || 'Members: ' || array_to_string(member_names, ', ') || chr(10)
  || 'Mapper relevance score: ' || printf('%.2f', relevance_score) || chr(10) || '[/MAPPER_CLAIM]' || chr(10) || chr(10) || '[MAPPER_EVIDENCE]' || chr(10) || array_to_string(evidence, ', ') || chr(10) || '[/MAPPER_EVIDENCE]' AS message
FROM graded WHERE skip_reason IS NULL"""
LENGTHS = """WITH x AS (SELECT source, length(coalesce(text, '')) <= 120 AS short, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}]+|\\p{N}+|[^\\s\\p{L}\\p{M}\\p{N}]')) <= 120 AS few FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (short) AS unmeasured, count(*) FILTER (short OR few) AS kept, count(*) FILTER (NOT (short OR few)) AS dropped FROM x GROUP BY 1"""
GRADE_TASKS = f"WITH {_GRADED} SELECT article_id, name AS group_name, asset_class, headline, relevance_score, array_to_string(evidence, ',') AS evidence FROM graded WHERE skip_reason IS NULL"
GRADE_SKIPS = f"WITH {_GRADED} SELECT skip_reason, count(*) AS n FROM graded WHERE skip_reason IS NOT NULL GROUP BY 1"
SELF = f"WITH {_GRADED} SELECT article_id, name AS group_name, verdict, grader_score, self_inconsistent FROM w"
SIDECAR = f"""WITH {_GRADED} SELECT article_id, name AS group_name, asset_class, verdict, grader_score, NULL::VARCHAR AS skip_reason FROM w
UNION ALL SELECT article_id, name, asset_class, 'skipped', NULL, skip_reason FROM graded WHERE skip_reason IS NOT NULL"""
_COUNTS = "count(*) AS total, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (self_inconsistent) AS self_inconsistent, round_even(100.0::DOUBLE * count(*) FILTER (verdict = 'correct') / count(*), 2) AS correct_pct"
RESULTS_OF = f"SELECT * FROM ({SELF}) WHERE article_id = 27"
GRADER_ROLLUP = f"WITH {_GRADED} SELECT 'asset_class' AS dimension, asset_class AS key, {_COUNTS} FROM w GROUP BY 2 UNION ALL SELECT 'group', name, {_COUNTS} FROM w GROUP BY 2"
_P = "regexp_extract_all(html, '<p>([^<]*)</p>', 1)"
_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
_TRAILER = "|".join(f"(?i:{t.removeprefix('(?i)')})" if t.startswith("(?i)") else t for t in TRAILERS)
NML_P = f"""WITH x AS (SELECT page_id, list_filter(list_transform({_P}, lambda p: {_TRIM.format('p')}), lambda p: p <> '' AND NOT regexp_matches(p, '{_TRAILER}')) AS ps FROM pages)
SELECT page_id, len(ps) AS n_p, sha256(array_to_string(ps, chr(10))) AS digest FROM x"""
NML_MERGE = f"""WITH x AS (SELECT regexp_extract(url, '//([^/?#]*)', 1) AS accession, min(page_id) AS first_seen, flatten(list({_P} ORDER BY page_id)) AS ps FROM pages GROUP BY 1)
SELECT accession, first_seen, len(ps) AS n_p, sha256(array_to_string(ps, chr(10))) AS digest FROM x"""
_REF = entities.REFERENCE.replace("\\t\\n\\f ", "\\t\\n\\f\\x20")


def _map(of: dict) -> str:
    return f"MAP([{', '.join(_quoted(str(k)) for k in of)}], [{', '.join(_quoted(v) for v in of.values())}])"


def _decoded(x: str) -> str:
    """html.unescape: the text is cut at its references, and each is looked up by number or by name."""
    nothing = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in entities.NONE)
    shown = f"coalesce(nums[n::VARCHAR], CASE WHEN n BETWEEN {0xD800} AND {0xDFFF} OR n > {entities.LAST} THEN '\ufffd' WHEN {nothing} OR n & {0xFFFE} = {0xFFFE} THEN '' ELSE chr(n::INTEGER) END)"
    of = lambda digits, most, value: f"list_transform([CASE WHEN length(ltrim({digits}, '0')) > {most} THEN {entities.LAST + 1} WHEN ltrim({digits}, '0') = '' THEN 0 ELSE {value} END], lambda n: {shown})[1]"
    dec, hexed = "regexp_extract(r, '^&#([0-9]+)', 1)", "regexp_extract(r, '^&#[xX]([0-9a-fA-F]+)', 1)"
    prefix = f"regexp_extract(r, '^&({'|'.join(entities.bare_names())})', 1)"
    one = f"CASE WHEN {dec} <> '' THEN {of(dec, 7, f'{dec}::BIGINT')} WHEN {hexed} <> '' THEN {of(hexed, 6, f"('0x' || {hexed})::BIGINT")} ELSE coalesce(names[r[2:]], CASE WHEN {prefix} <> '' THEN names[{prefix}] || substr(r, length({prefix}) + 2) END, r) END"
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{_REF}'), list_append(regexp_extract_all({x}, '{_REF}'), NULL)), lambda z: z[1] || coalesce(list_transform([z[2]], lambda r: {one})[1], '')), '')"


_ALL_SPACES = " || ".join(f"chr({ord(c)})" for c in SPACES)
NML_DOCUMENTS = f"""WITH known AS (SELECT {_map(html5)} AS names, {_map(entities.numbered())} AS nums),
x AS (SELECT page_id, regexp_extract_all(html, '(?s)<p\\b[^>]*>(.*?)</p>', 1) AS raw, len(regexp_extract_all(html, '(?s)<pre\\b[^>]*>(.*?)</pre>', 1)) AS n_pre, names, nums FROM pages, known),
d AS (SELECT page_id, n_pre, list_filter(list_transform(raw, lambda p: trim({_decoded('p')}, {_ALL_SPACES})), lambda p: p <> '' AND NOT regexp_matches(p, '{_TRAILER}')) AS ps FROM x)
SELECT page_id, len(ps) AS n_p, n_pre, sha256(array_to_string(ps, chr(10))) AS digest FROM d"""
_TOK = "list_filter(string_split_regex({0}, '\\s+'), lambda t: t <> '')"
_NUMERIC = "regexp_full_match(t, '[+\\-]?\\$?\\d[\\d.,/\\-:]*%?')"
_GAPS = f"len(regexp_extract_all({_TRIM.format('line')}, ' {{2,}}'))"
_LINE_SQL = f"""rendered AS (SELECT l_orderkey AS accession, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'line ' || l_linenumber || ' came back from the customer in good order'
  ELSE rpad(l_linenumber::VARCHAR, 4, ' ') || lpad(l_partkey::VARCHAR, 9, ' ') || lpad(l_quantity::BIGINT::VARCHAR, 6, ' ') || '  ' || l_linestatus END AS line FROM lineitem),
judged AS (SELECT *, len({_TOK.format('line')}) AS n_tokens, count(*) OVER (PARTITION BY accession) >= 3 AND (regexp_full_match(line, '[\\s=\\-:_|+*~.]*[=\\-:_|+*~.][\\s=\\-:_|+*~.]*') OR {_GAPS} >= 2
  OR ({_GAPS} >= 1 AND len(list_filter({_TOK.format('line')}, lambda t: {_NUMERIC})) / len({_TOK.format('line')}) >= 0.5)) AS is_tabular FROM rendered)"""
_ACC = f"""{_LINE_SQL}, c AS (SELECT accession, coalesce(sum(n_tokens) FILTER (is_tabular), 0)::BIGINT AS pre_tabular_tokens, coalesce(sum(n_tokens) FILTER (NOT is_tabular), 0)::BIGINT AS pre_narrative_tokens FROM judged GROUP BY 1),
acc AS (SELECT accession, coalesce(len(string_split(o_orderpriority, '-')), 0) AS p_tokens, pre_tabular_tokens, pre_narrative_tokens FROM c LEFT JOIN orders ON o_orderkey = accession),
tab AS (SELECT *, pre_tabular_tokens > 0 AND pre_tabular_tokens >= p_tokens AND pre_tabular_tokens >= pre_narrative_tokens AS is_tabular_body,
  CASE WHEN pre_tabular_tokens + pre_narrative_tokens > 0 THEN pre_tabular_tokens / (pre_tabular_tokens + pre_narrative_tokens) ELSE 0.0 END AS pre_aligned_pct FROM acc)"""
LINES = f"WITH {_LINE_SQL} SELECT accession, string_agg(CASE WHEN is_tabular THEN 'T' ELSE 'N' END, '' ORDER BY l_linenumber, l_partkey, line) AS flags, string_agg(n_tokens::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, line) AS n_tokens FROM judged GROUP BY 1"
ACCOUNTING = f"WITH {_ACC} SELECT * FROM tab"
TABULAR_JOIN = f"WITH {_ACC} SELECT doc_id AS article_id, CASE WHEN is_tabular_body THEN 'tabular_body' ELSE '' END AS reason FROM documents LEFT JOIN tab ON accession = doc_id"
_MEMBERS = "members(group_key, group_name, asset_class, asset, ticker_symbol, short_name) AS (VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(g['name'])}, {_quoted(g['asset_class'])}, {_quoted(m['name'])}, {_quoted(m['ticker_symbol'])}, {_quoted(m['short_name'])})" for k, g in sorted(FIXTURE.items()) for m in g["members"]) + ")"
LADDER = """SELECT event_id, CASE WHEN event_id % 5 <= 1 THEN '1,2' ELSE '' END AS evidence, CASE WHEN event_id % 5 <= 1 THEN value::DOUBLE ELSE 0.0 END AS relevance_score, event_id % 5 <= 1 AS relevant FROM events"""
GRADER_LADDER = """SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 4) THEN user_id || ',1' ELSE '' END AS evidence, CASE event_id % 6 WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 WHEN 4 THEN 0.1 ELSE 0.0 END::DOUBLE AS relevance_score,
  CASE WHEN event_id % 6 <= 1 THEN 'incorrect' ELSE 'correct' END AS verdict FROM events"""
_ID = "'2014' || lpad(({0} % 12 + 1)::VARCHAR, 2, '0') || '01' || lpad({0}::VARCHAR, 12, '0')"
WIRE = f"""WITH {_ACC}, x AS (SELECT d.*, length(text) <= 120 OR len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+|\\p{{N}}+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}]')) <= 120 AS kept, coalesce(t.is_tabular_body, false) AS body
  FROM documents d LEFT JOIN tab t ON t.accession = d.doc_id)
SELECT {_ID.format('doc_id')} AS id, string_split(text, chr(10))[1] AS headline, len(string_split(text, chr(10))) AS n_paragraphs,
  array_to_string(list_filter([CASE WHEN lang = 'de' THEN 'foreign' END, CASE WHEN body THEN 'tabular_body' END], lambda r: r IS NOT NULL), ',') AS reasons
FROM x WHERE kept AND doc_id % 12 + 1 BETWEEN 5 AND 8"""
WIKI = f"""WITH lines AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS line, string_split(text, chr(10))[1] AS title FROM documents),
documents AS (SELECT c.doc_id, l.source, c.cleaned AS text FROM ({CLEAN}) c JOIN lines l USING (doc_id)), {_ART}
SELECT 'wiki_' || CASE WHEN l.doc_id % 2 = 0 THEN 'p' || l.doc_id ELSE l.line::VARCHAR END AS id, l.title AS headline, l.source AS domain, len(paragraphs) AS n_paragraphs, sha256(array_to_string(paragraphs, chr(10) || chr(10))) AS digest
FROM art JOIN lines l ON l.doc_id = article_id WHERE len(paragraphs) > 0"""
RESUME = """SELECT DISTINCT '2014-' || lpad(m::VARCHAR, 2, '0') AS shard, CASE WHEN m >= 10 THEN 'other' WHEN m <= 3 THEN 'done' ELSE 'pending' END AS status FROM (SELECT doc_id % 12 + 1 AS m FROM documents)"""
RUN = f"""WITH {_TASKS}, k AS (SELECT * FROM tasks WHERE relevant) SELECT 'by_asset_class' AS field, asset_class AS key, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'by_group', name, count(*) FROM k GROUP BY 2
UNION ALL SELECT 'filtered_by_reason', reason, count(*) FROM (SELECT unnest(reasons) AS reason FROM art) GROUP BY 2 UNION ALL SELECT 'total_articles', '', count(*) FROM art
UNION ALL SELECT 'filtered_articles', '', count(*) FROM art WHERE len(reasons) > 0 UNION ALL SELECT 'total_mappings', '', count(*) FROM k"""
GRADED = f"""WITH {_GRADED}, t AS (SELECT count(*) AS total, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (self_inconsistent) AS odd FROM w),
s AS (SELECT skip_reason, count(*) AS n FROM graded WHERE skip_reason IS NOT NULL GROUP BY 1), z AS (SELECT coalesce(sum(n), 0)::BIGINT AS skipped FROM s)
SELECT 'total' AS field, 'total_mappings' AS key, total + skipped AS n, NULL::DOUBLE AS correct_pct FROM t, z UNION ALL SELECT 'total', 'graded', total, NULL FROM t UNION ALL SELECT 'total', 'correct', correct, NULL FROM t
UNION ALL SELECT 'total', 'incorrect', incorrect, NULL FROM t UNION ALL SELECT 'total', 'self_inconsistent', odd, NULL FROM t UNION ALL SELECT 'total', 'skipped', skipped, NULL FROM z UNION ALL SELECT 'skip', skip_reason, n, NULL FROM s
UNION ALL SELECT 'by_asset_class', asset_class, count(*), round_even(100.0::DOUBLE * count(*) FILTER (verdict = 'correct') / count(*), 2) FROM w GROUP BY 2
UNION ALL SELECT 'by_group', name, count(*), round_even(100.0::DOUBLE * count(*) FILTER (verdict = 'correct') / count(*), 2) FROM w GROUP BY 2"""
CORPUS = f"""SELECT {_ID.format('doc_id')} AS id, string_split(text, chr(10))[1] AS headline, source, '2014-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') AS month FROM documents WHERE doc_id IN (5, 27, 123, {10**11})"""
EXPLODE = f"WITH {_MEMBERS} SELECT * FROM members"
INTEGRITY = f"""WITH {_MEMBERS}, g AS (SELECT group_key, asset_class, count(*) AS n FROM members GROUP BY 1, 2)
SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_members, count(*) FILTER (n = 1) AS n_singletons, count(DISTINCT asset_class) AS n_classes, count(*) FILTER (asset_class <> 'US equity sector') AS n_mapper_groups FROM g"""
MISMATCH = f"WITH {_MEMBERS} SELECT 'Orphan Bond' AS name, 'asset' AS side UNION ALL SELECT DISTINCT asset, 'member' FROM members WHERE asset = 'Ghost Index'"
LISTING = f"WITH {_MEMBERS} SELECT asset_class, string_agg(ticker_symbol || ' (' || asset || ')', ', ' ORDER BY ticker_symbol || ' (' || asset || ')') AS listing FROM members GROUP BY 1"
CODES = """SELECT source AS code, CASE source WHEN 'src0' THEN 'main wire' WHEN 'src1' THEN 'market desk' ELSE '??? (undocumented)' END AS description, count(*) AS n FROM documents GROUP BY 1, 2"""
LIMIT_BEFORE = "SELECT doc_id, source FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100) WHERE lang = 'en'"
LIMIT_AFTER = "SELECT doc_id, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100"
LAST_WINS = "SELECT conv_id, turn, role, sha256(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations) WHERE rn = 1"
PAIRS = """WITH p AS (SELECT conv_id, turn, '[{"role":"system","content":"Answer with one object."},{"role":"user","content":' || to_json(text)::VARCHAR || '}]' AS messages FROM conversations WHERE role = 'user')
SELECT conv_id, turn, length(messages) AS n_chars, messages FROM p"""
PENDING = """WITH done AS (SELECT DISTINCT source FROM documents WHERE lang = 'en' AND source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1))
SELECT DISTINCT source, CASE WHEN source IN (SELECT source FROM done) THEN 'done' ELSE 'pending' END AS status FROM documents"""
LOOKUP = "SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 42"
_TREE = ", ".join(f"t{k} AS (SELECT id >> 12 AS id, sha256(string_agg(d, '' ORDER BY id)) AS d FROM t{k - 1} GROUP BY 1)" for k in range(1, 6))
FINGERPRINT = f"""WITH {_OPEN}, p AS (SELECT article_id, group_key, sha256({_PROMPT}) AS d FROM fired),
  t0 AS (SELECT article_id AS id, sha256(string_agg(d, '' ORDER BY group_key)) AS d FROM p GROUP BY 1), {_TREE}
SELECT (SELECT count(*) FROM opened) AS surviving, (SELECT count(*) FROM p) AS calls, left(sha256(string_agg(d, '' ORDER BY id)), 16) AS digest FROM t5"""
