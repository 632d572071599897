"""What must come out of the queries of made.py, as SQL over the tables that their inputs are made from."""

from __future__ import annotations

from ..operators.contracts import CATEGORIES
from .oracle import BOOT, DAY_TRACES, LINES, RUNS

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
DIFF = f"""
r AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS nth,
        CASE l_returnflag WHEN 'N' THEN ' ' WHEN 'R' THEN '-' WHEN 'A' THEN '+' END AS prefix, l_linestatus || (l_partkey % 100) AS text FROM lineitem),
d AS (SELECT *, 'd' || (k % 3) || '/f' || CASE WHEN k % 2 = 0 THEN CAST(h AS VARCHAR) ELSE '' END || '.py' AS path,
        CASE WHEN k % 2 = 0 THEN 1 ELSE dense_rank() OVER (PARTITION BY k ORDER BY h) END AS hunk_no, row_number() OVER w - 1 AS pos,
        k % 50 + 1 + (h - 1) * 100 AS old_start, k % 70 + 1 + (h - 1) * 100 AS new_start,
        count(*) FILTER (prefix <> '+') OVER (PARTITION BY k, h) AS old_count, count(*) FILTER (prefix <> '-') OVER (PARTITION BY k, h) AS new_count,
        count(*) FILTER (prefix <> '+') OVER (PARTITION BY k, h ORDER BY nth) AS olds, count(*) FILTER (prefix <> '-') OVER (PARTITION BY k, h ORDER BY nth) AS news
      FROM r WINDOW w AS (PARTITION BY k, h ORDER BY nth))
"""
_CASES = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"


def _rule(ok: str, said: str) -> str:
    return f"CASE WHEN NOT coalesce({ok}, false) THEN '{said}' END"


#: k is the part's key; n and m are the numbers of defects and distractors, c the categories.
_GOLD_RULES = ", ".join(
    _rule(*x)
    for x in (
        ("k % 11 <> 0", "gold id differs from directory name"),
        ("k % 4 <> 3", "unknown difficulty"),
        ("k % 35 = 0 OR k % 5 <> 4", "unknown source kind"),
        ("k % 5 <> 3", "synthetic source carries extra fields"),
        ("k % 35 <> 0", "oss source misses a field"),
        ("k % 5 <> 1", "license isn''t permissive"),
        ("k % 35 <> 0", "oss source has unknown fields"),
        ("n BETWEEN 1 AND 4", "defects must number 1 to 4"),
        ("n = 0 OR k % 19 <> 0", "unknown category"),
        ("n = 0 OR k % 7 <> 0", "defect lines must be two numbers, 1 <= start <= end"),
        ("m = 0 OR k % 2 = 0 OR k % 5 > 0", "distractor lines must be two numbers, 1 <= start <= end"),
        ("CASE k % 4 WHEN 0 THEN n = 1 WHEN 1 THEN n = 2 WHEN 2 THEN n IN (3, 4) END", "number of defects doesn''t fit the difficulty"),
        ("CASE k % 4 WHEN 0 THEN m <= 1 WHEN 1 THEN m >= 1 WHEN 2 THEN m >= 2 END", "number of distractors doesn''t fit the difficulty"),
        ("k % 4 = 0 OR len(list_distinct(c)) = n AND k % 4 < 3 OR len(list_distinct(c)) = n", "defect categories must be distinct"),
        ("n = 0 OR k % 13 <> 0", "defect ids must be d1, d2, ..."),
        ("m = 0 OR k % 23 <> 0", "distractor ids must be x1, x2, ..."),
        ("k % 17 <> 0", "gold has unknown keys"),
    )
)
GOLDS = f"""
p AS (SELECT DISTINCT p_partkey AS k, p_partkey % 6 AS n, p_partkey % 3 AS m,
        list_transform(range(p_partkey % 6), lambda i: CASE WHEN p_partkey % 19 = 0 THEN 'other' ELSE {_CASES}[1 + p_partkey * (i + 1) % 10] END) AS c FROM part),
v AS (SELECT 't' || k AS directory, list_filter([{_GOLD_RULES}], lambda x: x IS NOT NULL) AS violations FROM p)
"""
CLAIMS = f"""
c AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS nth, l_partkey % 4 AS file, l_suppkey % 4 AS quote, l_partkey % 10 = 0 AS mute FROM lineitem),
s AS (SELECT *, 'c' || CASE WHEN k % 9 = 0 THEN nth + 1 ELSE nth END AS id FROM c),
x AS (SELECT k, flatten(list(list_filter([CASE WHEN file = 3 THEN id || ': file isn''t in the diff' END, CASE WHEN quote = 1 THEN id || ': empty quote' END,
        CASE WHEN quote = 3 AND k % 6 <> 0 THEN id || ': quote isn''t verbatim' END, CASE WHEN mute THEN id || ': empty summary' END], lambda y: y IS NOT NULL) ORDER BY nth)) AS own FROM s GROUP BY k),
v AS (SELECT k AS trace_id, CASE WHEN k % 9 = 0 THEN list_prepend('claim ids must be c1, c2, ...', own) ELSE own END AS violations FROM x)
"""
#: Characters that stand in a JSON string of ASCII as they are, and those that don't.
JSON_TEXT = """('"' || array_to_string(list_transform(string_split({0}, ''), lambda ch: CASE
    WHEN ch = '"' THEN '\\"' WHEN ch = '\\' THEN '\\\\' WHEN ch = chr(10) THEN '\\n' WHEN ch = chr(13) THEN '\\r' WHEN ch = chr(9) THEN '\\t' WHEN ch = chr(8) THEN '\\b' WHEN ch = chr(12) THEN '\\f'
    WHEN unicode(ch) > 65535 THEN '\\u' || lower(to_hex(55296 + (unicode(ch) - 65536) // 1024)) || '\\u' || lower(to_hex(56320 + (unicode(ch) - 65536) % 1024))
    WHEN unicode(ch) BETWEEN 32 AND 126 THEN ch ELSE '\\u' || lpad(lower(to_hex(unicode(ch))), 4, '0') END), '') || '"')"""
_TEXT = JSON_TEXT.format("text")
LINES_OF_RUNS = """
e AS (SELECT event_id AS e, user_id AS u, CASE WHEN user_id % 2 = 0 THEN 'env--prov--beta--h--1' ELSE 'plain' END AS run FROM events),
w AS (SELECT e AS line_no, u, run, 0 AS trace_pos, (e % 100) / 1e2 AS f1, CASE WHEN e % 7 = 0 THEN -1e0 ELSE (e % 100) / 1e2 END AS recall, CASE WHEN e % 3 = 2 THEN 'm' || (u % 4) WHEN u % 2 = 0 THEN 'beta' ELSE 'plain' END AS model FROM e
      UNION ALL SELECT e, u, run, 1, 1e0, -1e0, 'z' FROM e WHERE e % 4 = 2)
"""
#: What each sub-task must be: the diff's body, its state and where it is anchored.
SUBS = """
t AS (SELECT s_suppkey AS k, 't' || s_suppkey AS task FROM supplier),
u AS (SELECT k, task, 'd1' AS d, 'a.py' AS path, 'data' AS category, 2 AS lo, '@@ -1,3 +1,3 @@' || chr(10) || ' keep' || chr(10) || '-old = ' || k || chr(10) || '+new = ' || k || chr(10) || ' tail' AS body, NULL AS reason, 'About a.py.' || chr(10) || chr(10) || 'None.' AS context,
        CASE WHEN k % 2 = 0 THEN 'x2' ELSE '' END AS kept FROM t
      UNION ALL SELECT k, task, 'd2', 'b.py', 'security', 11, '@@ -10,2 +10,3 @@' || chr(10) || ' x' || chr(10) || CASE WHEN k % 3 = 0 THEN '+call(1' ELSE '+value = 2' END || chr(10) || ' y', CASE WHEN k % 3 = 0 THEN 'brackets of the changed lines don''t match up' END,
        'About b.py and c.py.' || chr(10) || chr(10) || 'None.', CASE WHEN k % 2 = 0 THEN 'x1' ELSE '' END FROM t
      UNION ALL SELECT k, task, 'd3', 'c.py', 'injection', 2, '@@ -1,4 +1,4 @@' || chr(10) || ' l1' || chr(10) || '-a' || chr(10) || '+A = 1' || chr(10) || ' l3' || chr(10) || ' l4', NULL, 'About b.py and c.py.' || chr(10) || chr(10) || 'Only c.py.' || chr(10) || chr(10) || 'None.', CASE WHEN k % 2 = 1 THEN 'x1' ELSE '' END FROM t
      UNION ALL SELECT k, task, 'd4', 'c.py', 'resilience', 6, '@@ -4,4 +4,4 @@' || chr(10) || ' l4' || chr(10) || ' l5' || chr(10) || '-b' || chr(10) || '+B = 2' || chr(10) || ' l7', NULL, 'About b.py and c.py.' || chr(10) || chr(10) || 'Only c.py.' || chr(10) || chr(10) || 'None.', CASE WHEN k % 2 = 1 THEN 'x1' ELSE '' END FROM t),
g AS (SELECT *, 'c' || substr(kept, 2) AS concern, CASE WHEN kept = 'x2' THEN '[1,1]' ELSE 'null' END AS span FROM u)
"""
#: The distractor that a sub-task inherits, as JSON.
_INHERITED = """CASE WHEN kept = '' THEN '' ELSE '{"id":"x1","file":"' || path || '","lines":' || span || ',"concern":"' || concern || '","why_ok":"w"}' END"""


def _table(which: str) -> str:
    cell = "coalesce(printf('%.2f', avg(f1) FILTER (model = '{0}')), '—')"
    mean = "coalesce('**' || printf('%.2f', avg(f1) FILTER (model = '{0}')) || '**', '—')"
    models = ("m0", "m1", "m2")
    own = f"FROM r WHERE population = '{which}'"
    return f"""SELECT 'table' AS kind, CAST(0 AS BIGINT) AS line_no, '| Task | m0 F1 | m1 F1 | m2 F1 |' AS line UNION ALL SELECT 'table', 1, '|---|---|---|---|'
        UNION ALL SELECT 'table', 1 + row_number() OVER (ORDER BY task_id), '| ' || task_id || ' | ' || {" || ' | ' || ".join(cell.format(m) for m in models)} || ' |' {own} GROUP BY task_id
        UNION ALL SELECT 'table', 2 + count(DISTINCT task_id), '| **Mean** | ' || {" || ' | ' || ".join(mean.format(m) for m in models)} || ' |' {own}"""


def _detail(which: str, model: str) -> str:
    cells = " || ' | ' || ".join(f"printf('%.{n}f', avg({c}))" for c, n in (("recall", 2), ("precision", 2), ("claim_count", 1), ("false_alarms", 1), ("distractor_hits", 1)))
    own = f"FROM r WHERE population = '{which}' AND model = '{model}'"
    return f"""SELECT 'detail', 0, '| Task | F1 | Recall | Precision | Claims | False alarms | Distractor hits |' UNION ALL SELECT 'detail', 1, '|---|---|---|---|---|---|---|'
        UNION ALL SELECT 'detail', 1 + row_number() OVER (ORDER BY task_id), '| ' || task_id || ' | ' || printf('%.2f', avg(f1)) || ' | ' || {cells} || ' |' {own} GROUP BY task_id
        UNION ALL SELECT 'detail', 2 + count(DISTINCT task_id), '| **Mean** | **' || printf('%.2f', avg(f1)) || '** | ' || {cells} || ' |' {own}"""


_N = "chr(10)"
_HEAD = "'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || "

SQL = {
    "diff_parse": f"""WITH {DIFF} SELECT k AS task_id, path, hunk_no, pos, prefix, text, CAST(old_start AS INTEGER) AS old_start, CAST(old_count AS INTEGER) AS old_count, CAST(new_start AS INTEGER) AS new_start, CAST(new_count AS INTEGER) AS new_count,
        CAST(CASE WHEN prefix <> '+' THEN old_start + olds - 1 END AS INTEGER) AS old_no, CAST(CASE WHEN prefix <> '-' THEN new_start + news - 1 END AS INTEGER) AS new_no FROM d""",
    "diff_emit": f"""WITH {DIFF}, q AS (SELECT k, path, hunk_no, '@@ -' || any_value(old_start) || ',' || any_value(old_count) || ' +' || any_value(new_start) || ',' || any_value(new_count) || ' @@' || {_N} || string_agg(prefix || text, {_N} ORDER BY pos) AS said FROM d GROUP BY k, path, hunk_no),
        f AS (SELECT k, path, {_HEAD} string_agg(said, {_N} ORDER BY hunk_no) AS said FROM q GROUP BY k, path)
        SELECT k AS task_id, sha256(string_agg(said, {_N} ORDER BY path) || {_N}) AS diff_sha256 FROM f GROUP BY k""",
    "diff_paths": f"WITH {DIFF} SELECT k AS task_id, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM d GROUP BY k",
    "hunk_headers": f"""WITH {LINES}, z AS (SELECT hunk, island, min(pos) AS p, max(pos) AS q, min(old_no) AS a, count(old_no) AS b, min(new_no) AS c, count(new_no) AS d, any_value(old_start) AS o, any_value(new_start) AS n FROM i GROUP BY hunk, island HAVING count(*) FILTER (prefix <> ' ') > 0),
        y AS (SELECT z.*, (SELECT max(old_no) FROM l WHERE l.hunk = z.hunk AND l.pos < z.p) AS before, (SELECT min(pos) FROM l WHERE l.hunk = z.hunk AND l.pos > z.q AND l.old_no IS NOT NULL) AS after FROM z)
        SELECT hunk, CAST(p AS BIGINT) AS first_pos, CAST(coalesce(a, before + 1, o) AS INTEGER) AS old_start, CAST(b AS INTEGER) AS old_count, CAST(coalesce(c, (SELECT min(new_no) FROM l WHERE l.hunk = y.hunk AND l.pos >= y.after), n) AS INTEGER) AS new_start, CAST(d AS INTEGER) AS new_count FROM y""",
    "line_conflicts": f"""WITH {LINES}, sp AS (SELECT o_orderkey AS hunk, unnest(['d1', 'd2', 'd3']) AS d, o_custkey % 5 + o_orderkey % 70 + 1 + unnest([0, 2, 9]) AS lo FROM orders)
        SELECT pl.hunk AS task_id, CAST(pl.pos AS BIGINT) AS pos, string_agg(DISTINCT d, ',' ORDER BY d) AS defects FROM pl JOIN sp ON sp.hunk = pl.hunk AND pl.place BETWEEN sp.lo AND sp.lo + 2 GROUP BY pl.hunk, pl.pos HAVING count(DISTINCT d) > 1""",
    "gold_violations": f"WITH {GOLDS} SELECT directory, len(violations) = 0 AS valid, len(violations) AS n, array_to_string(violations, '; ') AS said FROM v",
    "gold_quarantine": f"WITH {GOLDS} SELECT directory, violations[1] AS first FROM v",
    "claim_violations": f"WITH {CLAIMS} SELECT trace_id, len(violations) = 0 AS valid, len(violations) AS n, array_to_string(violations, '; ') AS said FROM v",
    "rate_violations": "SELECT s_name AS model, s_acctbal >= 0 AS valid FROM supplier",
    "zero_claims": f"""WITH {DAY_TRACES} SELECT trace_id, CASE WHEN q THEN 0e0 ELSE round(recall, 6) END AS recall, CASE WHEN q THEN 1e0 ELSE round(precision, 6) END AS precision, CASE WHEN q THEN 0e0 ELSE round(f1, 6) END AS f1,
        CASE WHEN q THEN CAST(0 AS BIGINT) ELSE claim_count END AS claim_count, CASE WHEN q THEN 0 ELSE duplicate END AS duplicate, CAST(CASE WHEN q THEN 0 ELSE 3 END AS BIGINT) AS categories FROM (SELECT *, CAST(split_part(trace_id, '-', 1) AS BIGINT) % 5 = 0 AS q FROM s)""",
    "trace_lines": f"WITH {LINES_OF_RUNS} SELECT line_no, CAST(trace_pos AS BIGINT) AS trace_pos, run, model, 't' || (line_no % 6) AS task_id, f1, recall FROM w",
    "model_order": f"WITH {LINES_OF_RUNS}, o AS (SELECT model, min((u % 2, line_no, trace_pos)) AS first FROM w GROUP BY model) SELECT model, row_number() OVER (ORDER BY first) AS place FROM o",
    "report_lines": f"WITH {RUNS} SELECT 'curated' AS population, * FROM ({_table('curated')} UNION ALL {_detail('curated', 'm0')}) UNION ALL SELECT 'sub-tasks', * FROM ({_table('sub-tasks')} UNION ALL {_detail('sub-tasks', 'm0')})",
    "significance_lines": f"""WITH {BOOT}, q AS (SELECT population, gap, row_number() OVER (PARTITION BY population ORDER BY gap) - 1 AS rank, count(*) OVER (PARTITION BY population) AS n FROM gap WHERE gap IS NOT NULL),
        e AS (SELECT population, max(gap) FILTER (rank = floor(0.025 * n)) AS lo, max(gap) FILTER (rank = floor(0.975 * n)) AS hi, avg(CASE WHEN gap > 0 THEN 1 ELSE 0 END) AS ahead FROM q GROUP BY population),
        ob AS (SELECT population, avg(f1) FILTER (model = 'm0') - avg(f1) FILTER (model = 'm1') AS gap, count(DISTINCT scenario) AS scenarios FROM r GROUP BY population)
        SELECT population, population || ': ' || scenarios || ' scenarios, gap ' || printf('%+.3f', gap) || ', 95% CI [' || printf('%+.3f', lo) || ', ' || printf('%+.3f', hi) || '], P(ahead) ' || printf('%.2f', ahead) || ' — ' ||
          CASE WHEN lo > 0 OR hi < 0 THEN 'separated' ELSE 'not separated at 95%' END AS line FROM ob JOIN e USING (population)""",
    "verdict_keys": f"""SELECT conv_id, turn, substr(sha256('{{"gold":"' || sha256(role) || '","model":"m\\"\\\\1","prompt":"v\\u00e9 2","review":"' || substr(sha256('{{"review":' || {_TEXT} || '}}'), 1, 16) || '","task_id":"t' || conv_id || '"}}'), 1, 16) AS key FROM conversations""",
    "canonical_keys": f"""SELECT conv_id, turn, substr(sha256('{{"review":' || {_TEXT} || '}}'), 1, 16) AS review_hash FROM conversations""",
    "gold_versions": """SELECT s_suppkey AS k, sha256('{"defects":[],"difficulty":"easy","distractors":["' || s_name || '"],"id":"t' || s_suppkey || '","prompt_notes":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'n' ELSE '' END || '","source":{"kind":"synthetic"}}') AS version FROM supplier""",
    "request_prompts": f"""WITH q AS (SELECT *, CASE turn % 5 WHEN 0 THEN '{{"type":"object","required":["a"]}}' WHEN 1 THEN '{{"yes":1}}' END AS schema,
          CASE turn % 5 WHEN 0 THEN '{{' || {_N} || '  "type": "object",' || {_N} || '  "required": [' || {_N} || '    "a"' || {_N} || '  ]' || {_N} || '}}' WHEN 1 THEN '{{' || {_N} || '  "yes": 1' || {_N} || '}}' END AS laid FROM conversations)
        SELECT conv_id, turn, sha256(array_to_string(list_filter([CASE WHEN schema IS NOT NULL THEN 'Output must be a single JSON object matching this JSON Schema:' END, laid, CASE turn % 4 WHEN 0 THEN 'be brief' WHEN 1 THEN 'a' END, CASE turn % 4 WHEN 1 THEN 'b' END,
          CASE turn % 3 WHEN 0 THEN role || ': ' || text WHEN 1 THEN role || ': ' || text || {_N} || 'z' END, 'user: last'], lambda x: x IS NOT NULL), {_N} || {_N})) AS prompt_sha256,
          schema, CASE WHEN role = 'user' THEN 'judge' ELSE 'reviewer' END AS model, true AS ours FROM q""",
    "judge_replay": """WITH q AS (SELECT conv_id || '-' || turn AS trace_id, turn, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS review FROM conversations)
        SELECT trace_id, turn % 5 <> 4 AND trim(review) <> '' AND turn % 3 = 0 AS degraded, CAST(CASE WHEN turn % 5 = 4 OR trim(review) = '' OR turn % 3 = 0 THEN 0 ELSE 2 END AS BIGINT) AS claims, CASE WHEN NOT (turn % 5 = 4 OR trim(review) = '' OR turn % 3 = 0) THEN substr(review, 1, 9) END AS quote FROM q""",
    "judge_verdicts": """WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders) SELECT k AS trace_id, CAST(0 AS BIGINT) AS pos, 'c1' AS claim_id, 'matched' AS kind, 'd' || (k % 4) AS defect_id, 'full' AS status, false AS unsure FROM o
        UNION ALL SELECT k, 1, 'c2', 'false_alarm', NULL, NULL, true FROM o WHERE k % 3 <> 0""",
    "rewards": "SELECT o_orderkey AS trace_id, min(o_custkey) % 2 / 2e0 + CASE WHEN min(o_custkey) % 3 = 0 THEN 1e0 ELSE 0e0 END AS reward FROM orders GROUP BY 1",
    "code_names": """WITH q AS (SELECT p_partkey, p_partkey % 97 AS k FROM part) SELECT p_partkey, CASE k % 3 WHEN 0 THEN 'f' || k || ',w' WHEN 1 THEN '' ELSE 'p,r' || k END AS used,
        CASE k % 3 WHEN 0 THEN 'v' || k WHEN 1 THEN 'a,b' || k ELSE 'g' || k || ',p,q' END AS bound, CASE k % 3 WHEN 2 THEN 'p,q' ELSE '' END AS parameters, true AS binding FROM q""",
    "decomposed": f"""WITH {SUBS} SELECT task || '-' || d AS id, task AS parent, d AS parent_defect, sha256({_HEAD} body || {_N}) AS diff_sha256, context, CASE WHEN reason IS NULL THEN 'clean' ELSE 'needs-hand-write' END AS status, reason, false AS shared,
        task || '-' || d AS gold_id, 'easy' AS difficulty, 'd1' AS defect_id, category, path, lo || ',' || lo AS lines, CASE WHEN kept = '' THEN '' ELSE 'x1' || concern END AS distractors, 'notes' AS notes FROM g""",
    "subtask_gate": f"""WITH {SUBS} SELECT task || '-' || d AS id, k % 7 <> 0 AS valid, CASE WHEN k % 7 = 0 THEN 'license isn''t permissive' ELSE '' END AS reason,
        sha256('{{"id":"' || task || '-' || d || '","difficulty":"easy","source":' || CASE WHEN k % 7 = 0 THEN '{{"kind":"oss","url":"u","license":"GPL-3.0","attribution":"a"}}' ELSE '{{"kind":"synthetic"}}' END || ',"defects":[{{"id":"d1","category":"' || category || '","file":"' || path ||
          '","lines":[' || lo || ',' || lo || '],"summary":"s' || k || '","rationale":"r"}}],"distractors":[' || {_INHERITED} || '],"prompt_notes":"notes"}}') AS gold_sha256 FROM g""",
    "gold_views": """WITH t AS (SELECT s_suppkey AS k FROM supplier), d AS (SELECT k, unnest(['1', '2', '3', '4']) AS n, unnest(['data', 'security', 'injection', 'resilience']) AS c, unnest(['a', 'b', 'c', 'c']) AS p, unnest(['2', '11', '2', '6']) AS lo FROM t),
        dd AS (SELECT k, string_agg('{"id":"d' || n || '","category":"' || c || '","file":"' || p || '.py","lines":["' || lo || '","' || lo || '"],"summary":"s' || k || '"}', ',' ORDER BY n) AS said FROM d GROUP BY k),
        x AS (SELECT k, CASE WHEN k % 2 = 0 THEN [('1', 'b', 'null'), ('2', 'a', '["1","1"]'), ('3', 'b', 'null')] ELSE [('1', 'c', 'null'), ('2', 'c', 'null')] END AS xs FROM t)
        SELECT 't' || k AS task_id, sha256('{"defects":[' || said || '],"distractors":[' || array_to_string(list_transform(xs, lambda y: '{"id":"x' || y[1] || '","file":"' || y[2] || '.py","lines":' || y[3] || ',"concern":"c' || y[1] || '","why_ok":"w"}'), ',') || ']}') AS view_sha256 FROM dd JOIN x USING (k)""",
    "loaded_tasks": f"""WITH q AS (SELECT r_regionkey AS k, r_name AS name, 'f' || r_regionkey || '.py' AS path FROM region),
        d AS (SELECT *, 'diff --git a/' || path || ' b/' || path || {_N} || '--- a/' || path || {_N} || '+++ b/' || path || {_N} || '@@ -1,1 +1,1 @@' || {_N} || '-old' || {_N} || '+new ' || name || {_N} AS diff FROM q)
        SELECT 't00' || k || '-x' AS task_id, path AS files, sha256('## Context' || {_N} || {_N} || 'About ' || name || {_N} || {_N} || {_N} || '## Description' || {_N} || {_N} || CASE WHEN k % 2 = 0 THEN name ELSE '(no description provided)' END || {_N} || {_N} || '## Diff' || {_N} || {_N} || diff) AS prompt_sha256,
          path AS file, '1,1' AS lines, 'r: #1' AS rationale, 'clean' AS status, 'p' AS parent, 'assayer' AS generator FROM d""",
    "read_runs": f"WITH {LINES_OF_RUNS} SELECT run, CAST(CASE WHEN run = 'plain' THEN 1 ELSE 0 END AS INTEGER) AS run_ord, CAST(trace_pos AS BIGINT) AS trace_pos, model, 't' || (line_no % 6) AS task_id, f1 FROM w",
    "read_templates": f"""WITH q AS (SELECT r_regionkey AS k, r_name AS name, 'f.py' AS path FROM region)
        SELECT 't00' || k || '-x' AS id, {_HEAD} '@@ -1,3 +1,3 @@' || {_N} || ' a' || {_N} || '-b' || {_N} || '+b: #' || {_N} || ' ' || name || {_N} AS diff, name AS summary, 'Find: claims' || {_N} AS prompt, 'extractor.v3' AS version FROM q""",
    "generated": f"""WITH q AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN '@@ -1,3 +1,3 @@' || {_N} || ' one' || {_N} || '-two ' || p_partkey || {_N} || '+TWO ' || p_partkey || {_N} || ' three'
          WHEN 1 THEN '@@ -2,2 +2,3 @@' || {_N} || ' two ' || p_partkey || {_N} || '+new' || {_N} || ' three' ELSE '@@ -1,3 +1,2 @@' || {_N} || ' one' || {_N} || '-two ' || p_partkey || {_N} || ' three' END AS body, 'f.py' AS path FROM part)
        SELECT 't' || k AS id, {_HEAD} body || {_N} AS diff, CASE WHEN k % 5 = 0 THEN 'fam' ELSE '' END AS family, CASE WHEN k % 2 = 0 THEN 'medium' ELSE 'easy' END AS difficulty, '2,3' AS lines, CAST(0 AS BIGINT) AS distractors FROM q""",
}
