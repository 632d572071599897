"""The bridge queries as SQL over the same tables."""

from __future__ import annotations

DAY_TRACES = """
v AS (SELECT concat(user_id, '-', strftime(ts, '%Y%m%d')) AS trace_id, user_id, day(ts) AS day,
        row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos,
        CASE event_type WHEN 'view' THEN 'distractor' WHEN 'error' THEN 'false_alarm' ELSE 'matched' END AS kind,
        CASE WHEN event_type IN ('purchase', 'click', 'signup') THEN 'd' || (event_id % 4 + 1) END AS defect_id,
        CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'd' || ((event_id + 1) % 4 + 1) END AS second_defect_id,
        CASE WHEN event_type = 'click' THEN 'partial' ELSE 'full' END AS status, event_id % 17 = 0 AS unsure
      FROM events),
t AS (SELECT DISTINCT trace_id, 't00' || (day % 6 + 1) || CASE WHEN user_id % 2 = 1 THEN '-d1' ELSE '' END AS task_id, 'm' || (user_id % 3) AS model FROM v),
g AS (SELECT unnest(['d1', 'd2', 'd3', 'd4']) AS defect_id, unnest(['concurrency', 'data', 'security', 'data']) AS category),
c AS (SELECT trace_id, pos, status, defect_id FROM v WHERE kind = 'matched'
      UNION ALL SELECT trace_id, pos, status, second_defect_id FROM v WHERE kind = 'matched' AND second_defect_id IS NOT NULL),
f AS (SELECT trace_id, defect_id, min(pos) FILTER (status = 'full') AS first_full FROM c GROUP BY ALL),
u AS (SELECT c.trace_id, c.pos, bool_and(coalesce(first_full < c.pos, false)) AS duplicate FROM c JOIN f USING (trace_id, defect_id) GROUP BY ALL),
k AS (SELECT c.trace_id, c.defect_id, CASE WHEN bool_or(status = 'full') THEN 1e0 ELSE 5e-1 END AS credit
      FROM c JOIN u USING (trace_id, pos) WHERE NOT duplicate GROUP BY ALL),
cr AS (SELECT t.trace_id, g.category, sum(coalesce(credit, 0)) / count(*) AS recall FROM t CROSS JOIN g LEFT JOIN k ON k.trace_id = t.trace_id AND k.defect_id = g.defect_id GROUP BY ALL),
a AS (SELECT trace_id, count(*) AS claim_count, count(*) FILTER (kind = 'distractor') AS distractor_hits,
        count(*) FILTER (kind = 'false_alarm') AS false_alarms, count(*) FILTER (unsure) AS review_required FROM v GROUP BY 1),
j AS (SELECT trace_id, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (NOT duplicate) AS matched FROM u GROUP BY 1),
kk AS (SELECT trace_id, sum(credit) AS credit FROM k GROUP BY 1),
s0 AS (SELECT t.*, claim_count, distractor_hits, false_alarms, review_required, coalesce(duplicate, 0) AS duplicate, coalesce(matched, 0) AS matched, coalesce(credit, 0) / 4e0 AS recall
       FROM t JOIN a USING (trace_id) LEFT JOIN j USING (trace_id) LEFT JOIN kk USING (trace_id)),
s1 AS (SELECT *, CASE WHEN claim_count <= duplicate THEN 1e0 ELSE matched / CAST(claim_count - duplicate AS DOUBLE) END AS precision FROM s0),
s AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s1)
"""
RUNS = DAY_TRACES + """,
o AS (SELECT *, claim_count - duplicate - distractor_hits AS old_n,
        CASE WHEN claim_count - duplicate - distractor_hits <= 0 THEN 1e0
             ELSE (claim_count - duplicate - distractor_hits - false_alarms) / CAST(claim_count - duplicate - distractor_hits AS DOUBLE) END AS old FROM s),
p AS (SELECT trace_id, task_id, model, recall, claim_count, false_alarms, distractor_hits,
        CASE WHEN claim_count <= duplicate THEN 1e0 ELSE (CASE WHEN old_n > 0 THEN round_even(old * old_n, 0) ELSE 0 END) / CAST(claim_count - duplicate AS DOUBLE) END AS precision FROM o),
r AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
        CASE WHEN regexp_matches(task_id, '-d[0-9]+$') THEN 'sub-tasks' ELSE 'curated' END AS population, regexp_replace(task_id, '-d[0-9]+$', '') AS scenario FROM p)
"""
BOOT = RUNS + """,
cell AS (SELECT population, scenario, model, sum(f1) AS total, count(*) AS n FROM r GROUP BY ALL),
known AS (SELECT population, scenario, row_number() OVER (PARTITION BY population ORDER BY scenario) - 1 AS place, count(*) OVER (PARTITION BY population) AS size
          FROM (SELECT DISTINCT population, scenario FROM cell)),
draws AS (SELECT population, draw, ((draw * 7919 + place * 104729 + 12345) * 48271 % 2147483647) % size AS place FROM known, (SELECT range AS draw FROM range(10000))),
gap AS (SELECT d.population, d.draw,
          sum(total) FILTER (model = 'm0') / sum(n) FILTER (model = 'm0') - sum(total) FILTER (model = 'm1') / sum(n) FILTER (model = 'm1') AS gap
        FROM draws d JOIN known k ON k.population = d.population AND k.place = d.place JOIN cell c ON c.population = k.population AND c.scenario = k.scenario GROUP BY ALL)
"""
LINES = """
l0 AS (SELECT l_orderkey AS hunk, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS INTEGER) AS pos,
         CASE l_returnflag WHEN 'N' THEN ' ' WHEN 'R' THEN '-' WHEN 'A' THEN '+' END AS prefix, l_linestatus AS state,
         l_orderkey % 50 + 1 AS old_start, l_orderkey % 70 + 1 AS new_start FROM lineitem),
l AS (SELECT *, CAST(CASE WHEN prefix <> '+' THEN old_start - 1 + sum(CASE WHEN prefix <> '+' THEN 1 ELSE 0 END) OVER w END AS INTEGER) AS old_no,
        CAST(CASE WHEN prefix <> '-' THEN new_start - 1 + sum(CASE WHEN prefix <> '-' THEN 1 ELSE 0 END) OVER w END AS INTEGER) AS new_no,
        lag(prefix, 1, ' ') OVER (PARTITION BY hunk ORDER BY pos) AS before
      FROM l0 WINDOW w AS (PARTITION BY hunk ORDER BY pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, sum(CASE WHEN (prefix = '-' AND before <> '-') OR (prefix = '+' AND before = ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY hunk ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM l),
m2 AS (SELECT *, row_number() OVER (PARTITION BY hunk, run, prefix ORDER BY pos) AS nth FROM m),
pl AS (SELECT x.*, CASE WHEN x.prefix = '+' THEN x.new_no WHEN x.prefix = '-' THEN coalesce(y.new_no, (SELECT min(z.new_no) FROM l z WHERE z.hunk = x.hunk AND z.pos > x.pos)) END AS place
       FROM m2 x LEFT JOIN m2 y ON y.hunk = x.hunk AND y.run = x.run AND y.nth = x.nth AND y.prefix = '+' AND x.prefix = '-'),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY hunk ORDER BY pos) AS island FROM l WHERE state = 'O'),
runs AS (SELECT hunk, min(pos) AS first_pos, count(old_no) AS old_count, count(new_no) AS new_count, count(*) AS n_lines, count(*) FILTER (prefix <> ' ') AS changes,
           min(new_no) FILTER (prefix = '+') AS plus_lo, max(new_no) FILTER (prefix = '+') AS plus_hi, min(new_no) AS lo FROM i GROUP BY hunk, island HAVING changes > 0)
"""
TOKENS = "greatest(1, length(text) // 4)"
BUDGET = f"""
b AS (SELECT conv_id, turn, {TOKENS} * 100 / 1e6 * length(role) * 10e0 + {TOKENS} / 1e6 * length(role) * 50e0 AS cost FROM conversations),
w AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent FROM b)
"""
NORMAL = "trim(regexp_replace(replace({}, '`', ''), '\\s+', ' ', 'g'))"

SQL = {
    "score_review": f"WITH {DAY_TRACES} SELECT trace_id, task_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1, distractor_hits, false_alarms, claim_count, duplicate, review_required FROM s",
    "category_recall": f"WITH {DAY_TRACES} SELECT trace_id, category, round(recall, 6) AS recall FROM cr",
    "trace_metrics": f"""WITH {DAY_TRACES}, m AS (UNPIVOT (SELECT trace_id, 2e0 AS scoring_formula, recall, precision, CAST(distractor_hits AS DOUBLE) AS distractor_hits, CAST(false_alarms AS DOUBLE) AS false_alarms,
        CAST(claim_count AS DOUBLE) AS claim_count, CAST(duplicate AS DOUBLE) AS duplicate, CAST(review_required AS DOUBLE) AS review_required FROM s) ON COLUMNS(* EXCLUDE trace_id) INTO NAME metric VALUE value)
        SELECT trace_id, metric, round(value, 6) AS value FROM m UNION ALL SELECT trace_id, 'recall_' || category, round(recall, 6) FROM cr""",
    "credit_state": f"WITH {DAY_TRACES} SELECT * FROM k",
    "duplicate_verdicts": f"WITH {DAY_TRACES} SELECT * FROM u",
    "rescore_rollouts": f"WITH {RUNS} SELECT trace_id, task_id, model, round(f1, 6) AS f1, round(precision, 6) AS precision FROM r",
    "report_by_task_model": f"WITH {RUNS} SELECT population, task_id, model, round(avg(f1), 6) AS f1, count(*) AS rollouts FROM r GROUP BY ALL",
    "report_grand_mean": f"WITH {RUNS} SELECT population, model, round(avg(f1), 6) AS f1, count(*) AS rollouts FROM r GROUP BY population, model",
    "report_pivot": f"WITH {RUNS} SELECT population, task_id, " + ", ".join(f"round(avg(f1) FILTER (model = '{m}'), 6) AS {m}" for m in ("m0", "m1", "m2")) + " FROM r GROUP BY population, task_id",
    "report_detail": f"WITH {RUNS} SELECT population, model, task_id, round(avg(f1), 6) AS f1, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("recall", "precision", "claim_count", "false_alarms", "distractor_hits")) + " FROM r GROUP BY GROUPING SETS ((population, model, task_id), (population, model))",
    "bootstrap_gap": f"WITH {BOOT} SELECT population, draw, round(gap, 6) AS gap FROM gap WHERE gap IS NOT NULL",
    "bootstrap_interval": f"""WITH {BOOT}, q AS (SELECT population, round(gap, 6) AS gap, row_number() OVER (PARTITION BY population ORDER BY round(gap, 6)) - 1 AS rank, count(*) OVER (PARTITION BY population) AS n FROM gap WHERE gap IS NOT NULL)
        SELECT population, max(n) AS n, max(gap) FILTER (rank = floor(0.025 * n)) AS lo, max(gap) FILTER (rank = floor(0.975 * n)) AS hi, round(avg(CASE WHEN gap > 0 THEN 1 ELSE 0 END), 6) AS ahead,
        max(gap) FILTER (rank = floor(0.025 * n)) > 0 OR max(gap) FILTER (rank = floor(0.975 * n)) < 0 AS separated FROM q GROUP BY population""",
    "bootstrap_observed": f"WITH {RUNS} SELECT population, round(avg(f1) FILTER (model = 'm0') - avg(f1) FILTER (model = 'm1'), 6) AS gap, count(DISTINCT scenario) AS scenarios FROM r GROUP BY population",
    "hunk_line_numbers": f"WITH {LINES} SELECT hunk, pos, prefix, old_no, new_no FROM l",
    "line_places": f"WITH {LINES} SELECT hunk, pos, place FROM pl",
    "hunk_runs": f"WITH {LINES} SELECT hunk, CAST(first_pos AS BIGINT) AS first_pos, CAST(old_count AS INTEGER) AS old_count, CAST(new_count AS INTEGER) AS new_count, n_lines FROM runs",
    "context_kept": f"""WITH {LINES}, x AS (SELECT *, state = 'O' AND prefix <> ' ' AS owned FROM l), y AS (SELECT *, bool_or(owned) OVER (PARTITION BY hunk ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM x)
        SELECT hunk, pos FROM y WHERE owned OR (prefix = ' ' AND near)""",
    "line_span_ownership": f"""WITH {LINES}, sp AS (SELECT o_orderkey AS hunk, 'd' || (o_custkey % 4 + 1) AS defect_id, o_custkey % 5 + o_orderkey % 70 + 1 AS lo FROM orders)
        SELECT pl.hunk, pl.pos, sp.defect_id FROM pl JOIN sp ON sp.hunk = pl.hunk AND pl.place BETWEEN sp.lo AND sp.lo + 3""",
    "gold_anchor": f"""WITH {LINES}, e AS (SELECT *, row_number() OVER (PARTITION BY hunk ORDER BY changes DESC, first_pos) AS rank FROM runs WHERE plus_lo IS NOT NULL OR new_count > 0)
        SELECT hunk, CAST(coalesce(plus_lo, lo) AS INTEGER) AS lo, CAST(coalesce(plus_hi, lo + new_count - 1) AS INTEGER) AS hi FROM e WHERE rank = 1""",
    "verbatim_containment": f"SELECT doc_id, item_id FROM (SELECT doc_id, {NORMAL.format('text')} AS said FROM documents) d JOIN (SELECT item_id, {NORMAL.format('text')} AS quote FROM benchmark) b ON contains(said, quote)",
    "contract_violations": """WITH tr AS (SELECT DISTINCT o_orderkey AS trace_id, o_orderkey % 6 AS task_id FROM orders),
        cl AS (SELECT trace_id, unnest(range(1, CAST(trace_id % 3 + 3 AS BIGINT))) AS claim_id FROM tr),
        v AS (SELECT l_orderkey AS trace_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS pos, l_linenumber AS claim_id,
          CASE WHEN l_partkey % 23 = 0 THEN 'other' WHEN l_returnflag = 'N' THEN 'matched' WHEN l_returnflag = 'R' THEN 'distractor' ELSE 'false_alarm' END AS kind,
          CASE WHEN l_partkey % 11 <> 0 THEN l_partkey % 5 END AS d1, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 5 END AS d2, l_suppkey % 4 AS df
          FROM lineitem JOIN tr ON tr.trace_id = l_orderkey),
        n AS (SELECT v.*, row_number() OVER (PARTITION BY v.trace_id, v.claim_id ORDER BY pos) AS nth, cl.claim_id IS NOT NULL AS known FROM v LEFT JOIN cl ON cl.trace_id = v.trace_id AND cl.claim_id = v.claim_id),
        w AS (SELECT trace_id, pos, CASE WHEN NOT known THEN 'verdict references an unknown claim' WHEN nth > 1 THEN 'claim has more than one verdict'
            WHEN kind = 'matched' AND d1 IS NULL THEN 'matched verdict has no defect' WHEN kind = 'matched' AND (d1 > 3 OR d2 > 3) THEN 'verdict credits an unknown defect'
            WHEN kind = 'matched' AND d1 = d2 THEN 'verdict credits the same defect twice' WHEN kind = 'distractor' AND df > 2 THEN 'distractor verdict cites an unknown file'
            WHEN kind = 'other' THEN 'verdict has an invalid kind' END AS reason FROM n
          UNION ALL SELECT trace_id, 9000000000000000000, 'claim has no verdict' FROM cl WHERE NOT EXISTS (FROM v WHERE v.trace_id = cl.trace_id AND v.claim_id = cl.claim_id))
        SELECT tr.trace_id, count(reason) = 0 AS valid, count(reason) AS n, arg_min(reason, pos) FILTER (reason IS NOT NULL) AS first FROM tr LEFT JOIN w ON w.trace_id = tr.trace_id GROUP BY tr.trace_id""",
    "dense_ids": "SELECT conv_id, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS dense, count(*) AS turns FROM conversations GROUP BY conv_id",
    "prompt_assembly": "WITH p AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1) SELECT conv_id, sha256(prompt) AS prompt_sha256, greatest(1, length(prompt) // 4) AS tokens FROM p",
    "token_estimate": f"SELECT role, CAST(sum({TOKENS}) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY role",
    "budget_running": f"WITH {BUDGET} SELECT conv_id, turn, round(cost, 6) AS cost, round(spent, 6) AS spent, round(greatest(0, 1 - spent), 6) AS remaining FROM w",
    "budget_hard_stop": f"WITH {BUDGET} SELECT conv_id, min(turn) AS stopped_at FROM w WHERE round(spent, 6) >= 2 GROUP BY 1",
    "content_keys": "SELECT doc_id, sha256(text) AS content_sha256, substr(sha256(concat_ws(chr(31), lang, source, doc_id)), 1, 16) AS short_key FROM documents",
    "context_prune": """WITH p AS (SELECT doc_id, array_to_string(list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: contains(p, 'the') OR NOT (contains(p, 'ing') OR contains(p, 'tion'))), chr(10) || chr(10)) AS kept FROM documents)
        SELECT doc_id, sha256(kept) AS kept_sha256, length(kept) AS kept_chars FROM p""",
    "delimiter_balance": "SELECT doc_id, length(regexp_replace(text, '[^(\\[{]', '', 'g')) - length(regexp_replace(text, '[^)\\]}]', '', 'g')) AS balance FROM documents",
    "label_precision_recall": """WITH n AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS hit, count(*) FILTER (quality = 0) AS said, count(*) FILTER (toxic = 1) AS gold FROM labels),
        p AS (SELECT *, coalesce(hit / CAST(said AS DOUBLE), 1) AS precision, coalesce(hit / CAST(gold AS DOUBLE), 1) AS recall FROM n)
        SELECT hit, said, gold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM p""",
    "model_from_path": """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'env--' || n_name END AS model,
        CASE WHEN n_regionkey <> 0 THEN 'given' WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'env--' || n_name END AS resolved, n_name AS parent, n_name || '.v2' AS stem FROM nation""",
    "diff_file_list": "SELECT r_regionkey, 'a/' || r_name || ',z/' || r_name AS files FROM region",
    "text_seams": f"""SELECT conv_id, turn, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS bare, lower(role) AS kind, sha256({NORMAL.format('text')}) AS normal,
        sha256('## Context' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN '(no description provided)' ELSE role END || chr(10) || chr(10) || '## Diff' || chr(10) || chr(10) || 'd') AS prompt,
        len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS identifiers FROM conversations""",
}
