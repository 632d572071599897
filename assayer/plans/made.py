"""Queries of parsing, decomposition, contracts, keys and requests. Their inputs are texts and nested
records made from the tables in such a way that SQL knows what must come out; made_sql.py says it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import contracts, diffs, inference, judging, ledger, names, runs, scoring, subtasks
from ..sources import tasks
from ..sources.runs import parse_lines, rollouts
from ..sources.sinks import checked, write_folders
from ..storage import folder
from . import bridge
from .bridge import rounded, table

#: Golds (some 0.2 ms each) of a task.
GOLDS = 1 << 14


def _text(*parts: Column | str) -> Column:
    """Texts and columns one after another; str is literal."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _numbers(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


# diffs


def made_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, diff: an order's lineitems as diff lines in two hunks, in one file or in one file each,
    with index lines, truly blank lines between hunks, and counts of one left out."""
    li = bridge.lineitems(spark, sf_dir, "k")
    k, h = F.col("k"), F.when(F.col("l_linenumber") <= 3, 1).otherwise(2)
    rows = li.select("k", h.alias("h"), "at", "prefix", _text(F.col("l_linestatus"), F.col("l_partkey") % 100).alias("line"))
    count = lambda mark: F.count_if(F.col("prefix").isin(" ", mark))
    side = lambda start, n: F.when(n == 1, _text(start)).otherwise(_text(start, ",", n))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "prefix", "line"))), lambda x: F.concat(x["prefix"], x["line"])), "\n")
    hunks = rows.groupBy("k", "h").agg(count("-").alias("old"), count("+").alias("new"), body.alias("body"))
    head = _text("@@ -", side(F.col("k") % 50 + 1 + (F.col("h") - 1) * 100, F.col("old")), " +", side(F.col("k") % 70 + 1 + (F.col("h") - 1) * 100, F.col("new")), " @@ tail\n")
    path = _text("d", F.col("k") % 3, "/f", F.when(F.col("k") % 2 == 0, F.col("h").cast("string")).otherwise(""), ".py")
    each = hunks.select("k", F.struct("h", path.alias("path"), F.concat(head, "body").alias("said")).alias("x"))
    file = lambda p: _text("diff --git a/", p, " b/", p, "\nindex 1..2 100644\n--- a/", p, "\n+++ b/", p, "\n")
    whole = F.transform("xs", lambda x, i: F.when((i > 0) & (F.get("xs", i - 1)["path"] == x["path"]), F.concat(F.lit("\n"), x["said"])).otherwise(F.concat(file(x["path"]), x["said"])))
    return each.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(F.col("k").alias("task_id"), _text(F.array_join(whole, "\n"), "\n").alias("diff"))


def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diffs.parse(made_diffs(spark, sf_dir))
    return rows.select("task_id", "path", F.col("hunk_no").cast("long").alias("hunk_no"), F.col("pos").cast("long").alias("pos"), "prefix", "text", "old_start", "old_count", "new_start", "new_count", "old_no", "new_no")


def diff_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = diffs.whole_hunks(diffs.parse(made_diffs(spark, sf_dir)), diffs.HUNK).withColumn("place", F.col("hunk_no"))
    return diffs.emit(whole, ["task_id"]).select("task_id", F.sha2("diff", 256).alias("diff_sha256"))


def diff_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_diffs(spark, sf_dir).select("task_id", F.array_join(T.diff_files(F.col("diff")), ",").alias("files"))


def hunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of sub-hunks, those without old or without new lines among them."""
    r = bridge._runs(spark, sf_dir)
    return r.select("hunk", F.element_at("lines", 1)["pos"].cast("long").alias("first_pos"), "old_start", "old_count", "new_start", "new_count")


def line_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines that several defects own."""
    o = table(spark, sf_dir, "orders")
    lo = (F.col("o_custkey") % 5 + F.col("o_orderkey") % 70 + 1).cast("int")
    one = o.select(F.col("o_orderkey").alias("task_id"), F.lit("f").alias("path"), lo.alias("lo"))
    spans = one.select("task_id", F.explode(F.array(*[F.struct(F.lit(d).alias("defect_id"), (F.col("lo") + a).alias("lo"), (F.col("lo") + a + 2).alias("hi")) for d, a in (("d1", 0), ("d2", 2), ("d3", 9))])).alias("x"), "path").select("task_id", "x.*", "path")
    lines = diffs.positioned(bridge.hunk_lines(spark, sf_dir), ["hunk"]).withColumns({"task_id": F.col("hunk"), "path": F.lit("f"), "hunk_no": F.lit(1)})
    return diffs.conflicts(bridge.owned(spark, sf_dir, lines, spans)).select("task_id", F.col("pos").cast("long").alias("pos"), F.array_join("defects", ",").alias("defects"))


# contracts


def made_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """directory, gold (JSON): parts as golds; every rule has golds that break it."""
    k = F.col("p_partkey")
    own = bridge.dealt(table(spark, sf_dir, "part").select(k.alias("k")), "k", GOLDS).distinct()
    k, where = F.col("k"), _text("t", F.col("k"))
    pairs = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    source = (
        F.when(k % 35 == 0, pairs("kind", "oss", "url", "u", "license", "MIT", "more", "m"))
        .when(k % 5 == 0, pairs("kind", "oss", "url", "u", "license", "MIT", "attribution", "a"))
        .when(k % 5 == 1, pairs("kind", "oss", "url", "u", "license", "GPL-3.0", "attribution", "a"))
        .when(k % 5 == 2, pairs("kind", "synthetic"))
        .when(k % 5 == 3, pairs("kind", "synthetic", "url", "u"))
        .otherwise(pairs("kind", "mystery"))
    )
    category = lambda i: F.when(k % 19 == 0, "other").otherwise(_pick(k * (i + 1) % 10, contracts.CATEGORIES))
    number = lambda p, i, off: _text(p, i + F.when(off, 0).otherwise(1))
    lines = lambda i: F.when((k % 7 == 0) & (i == 0), F.array(F.lit(5), F.lit(2))).otherwise(F.array(i + 1, i + 3))
    defects = F.transform(_numbers(k % 6), lambda i: F.struct(number("d", i, k % 13 == 0).alias("id"), category(i).alias("category"), F.lit(" f.py ").alias("file"), lines(i).alias("lines"), F.lit("s").alias("summary"), F.lit("r").alias("rationale")))
    span = F.when(k % 2 == 1, F.array(F.lit(2), (k % 5 + 1).cast("int")))
    distractors = F.transform(_numbers(k % 3), lambda i: F.struct(number("x", i, k % 23 == 0).alias("id"), F.lit("g.py").alias("file"), span.alias("lines"), F.lit("c").alias("concern"), F.lit("w").alias("why_ok")))
    gold = F.struct(F.when(k % 11 == 0, "x").otherwise(where).alias("id"), _pick(k % 4, ["easy", "medium", "hard", "odd"]).alias("difficulty"), source.alias("source"), defects.alias("defects"), distractors.alias("distractors"))
    said = F.to_json(gold, {"ignoreNullFields": "false"})
    rows = own.select("k", where.alias("directory"), said.alias("said"))
    return rows.select("directory", F.when(F.col("k") % 17 == 0, F.regexp_replace("said", r"\}$", ',"more":1}')).otherwise(F.col("said")).alias("gold"))


def _said(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, "valid", F.size("violations").cast("long").alias("n"), F.array_join("violations", "; ").alias("said"))


def gold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(contracts.validate_gold(made_golds(spark, sf_dir)), "directory")


def gold_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = contracts.quarantine(contracts.validate_gold(made_golds(spark, sf_dir)))
    return good.select("directory", F.lit(None).cast("string").alias("first")).unionByName(bad.select("directory", F.col("violations")[0].alias("first")))


def claim_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as the claims of their order's review."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    k, at = F.col("l_orderkey"), F.row_number().over(order)
    claim = F.struct(
        at.alias("at"),
        _text("c", F.when(k % 9 == 0, at + 1).otherwise(at)).alias("id"),
        _pick(F.col("l_partkey") % 4, ["a.py", " b.py ", "general", "z.py"]).alias("file"),
        _pick(F.col("l_suppkey") % 4, ["beta gamma", " ", "delta`` epsilon", "gone missing"]).alias("quote"),
        F.when(F.col("l_partkey") % 10 == 0, " \t").otherwise("s").alias("summary"),
    )
    rows = li.select(k.alias("trace_id"), claim.alias("claim")).groupBy("trace_id").agg(F.array_sort(F.collect_list("claim")).alias("claims"))
    review = F.when(F.col("trace_id") % 6 != 0, "alpha `beta` gamma\n  delta epsilon")
    return _said(contracts.validate_claims(rows.select("trace_id", "claims", F.array(F.lit("a.py"), F.lit("b.py")).alias("file_list"), review.alias("review"))), "trace_id")


def rate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("model"), F.col("s_acctbal").alias("input_per_1m"), F.abs("s_acctbal").alias("output_per_1m"))
    return contracts.validate_rates(s).select("model", "valid")


# scores, runs and reports


def zero_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_review where every fifth user's reviews say nothing."""
    v = bridge.verdicts(spark, sf_dir)
    some = v.where("user_id % 5 <> 0")
    s = scoring.score_reviews(bridge.traces(v).drop("model"), bridge.golds(spark), some.select("trace_id", "claim_id"), some)
    return rounded(s.select("trace_id", "recall", "precision", "f1", "claim_count", "duplicate", F.size("per_category").cast("long").alias("categories")), "recall", "precision", "f1")


def made_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, run_ord, line_no, line: an event as a line of a run with two traces."""
    e = F.col("event_id")
    score = _text("0.", F.lpad((e % 100).cast("string"), 2, "0"))
    model = F.when(e % 3 == 0, "null").when(e % 3 == 1, '{"model":""}').otherwise(_text('{"model":"m', F.col("user_id") % 4, '"}'))
    first = _text('{"rewards":{"f1":{"score":', score, '},"other":{"score":1.0}},"agent":', model, ',"metrics":', F.when(e % 7 == 0, "null").otherwise(_text('{"recall":', score, "}")), "}")
    second = F.when(e % 4 == 0, ',{"rewards":null}').when(e % 4 == 1, ',{"rewards":{"other":{"score":1.0}}}').when(e % 4 == 2, ',{"rewards":{"f1":{"score":1.0}},"agent":{"model":"z"}}').otherwise("")
    line = _text('{"task":{"data":{"task_id":"t', e % 6, '"}},"traces":[', first, second, "]}")
    run = F.when(F.col("user_id") % 2 == 0, "env--prov--beta--h--1").otherwise("plain")
    return table(spark, sf_dir, "events").select(run.alias("run"), (F.col("user_id") % 2).alias("run_ord"), e.alias("line_no"), line.alias("line"))


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_lines(made_lines(spark, sf_dir))
    return rows.select("line_no", F.col("trace_pos").cast("long").alias("trace_pos"), "run", "model", "task_id", "f1", F.coalesce(F.col("metrics")["recall"], F.lit(-1.0)).alias("recall"))


def model_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.model_order(parse_lines(made_lines(spark, sf_dir))).select("model", F.col("place").cast("long").alias("place"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown tables of both populations, line by line."""
    r = bridge.rollouts(spark, sf_dir)
    models = ["m0", "m1", "m2"]
    rows = [(p, "table", i, x) for p in ("curated", "sub-tasks") for i, x in enumerate(runs.markdown_table(r, p, models).split("\n"))]
    rows += [(p, "detail", i, x) for p in ("curated", "sub-tasks") for i, x in enumerate(runs.markdown_detail(r, p, "m0").split("\n"))]
    return spark.createDataFrame(rows, "population string, kind string, line_no long, line string")


def significance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inference.bootstrap(spark, bridge.rollouts(spark, sf_dir), bridge.A, bridge.B, seed=None)
    return spark.createDataFrame([(r["population"], inference.sentence(r)) for r in found.collect()], "population string, line string")


# keys, requests and the judge


def verdict_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    key = ledger.verdict_key(F.concat(F.lit("t"), F.col("conv_id").cast("string")), F.col("text"), F.sha2("role", 256), F.lit("vé 2"), F.lit('m"\\1'))
    return c.select("conv_id", "turn", key.alias("key"))


def gold_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    gold = F.to_json(F.struct(_text("t", k).alias("id"), F.lit("easy").alias("difficulty"), F.struct(F.lit("synthetic").alias("kind")).alias("source"), F.array().cast("array<string>").alias("defects"), F.array(F.col("s_name")).alias("distractors"), F.when(k % 2 == 0, "n").alias("prompt_notes")))
    return table(spark, sf_dir, "supplier").select(k.alias("k"), gold.alias("gold")).select("k", ledger.gold_version(F.col("gold")).alias("version"))


def made_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, body: a turn as a chat request in several shapes."""
    t, said = F.col("turn"), ledger.json_text(F.col("text"))
    block = lambda kind, x: _text('{"type":"', kind, '","text":', x, "}")
    content = F.when(t % 3 == 0, said).when(t % 3 == 1, _text("[", block("text", said), ",", block("image", said), ",", block("text", F.lit('"z"')), "]")).otherwise(F.lit("[]"))
    system = F.when(t % 4 == 0, F.lit('"be brief"')).when(t % 4 == 1, _text("[", block("text", F.lit('"a"')), ",", block("text", F.lit('"b"')), "]")).when(t % 4 == 2, F.lit('""')).otherwise(F.lit("null"))
    schema = F.when(t % 5 == 0, F.lit(',"response_format":{"json_schema":{"schema":{"type":"object","required":["a"]}}}')).when(
        t % 5 == 1, F.lit(',"tools":[{"type":"other","function":{"input_schema":{"no":1}}},{"type":"function","function":{"input_schema":{"yes":1}}}]')
    ).otherwise(F.lit(""))
    body = _text('{"model":"X-', F.col("role"), '","system":', system, ',"messages":[{"role":', ledger.json_text(F.col("role")), ',"content":', content, '},{"content":"last"}]', schema, "}")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))


def request_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, body = made_requests(spark, sf_dir), F.col("body")
    model = T.request_model(F.get_json_object(body, "$.model"), "x-user", "judge", "reviewer")
    return r.select("conv_id", "turn", F.sha2(T.prompt_of_request(body), 256).alias("prompt_sha256"), T.schema_snippet(body).alias("schema"), model.alias("model"), T.model_family(F.get_json_object(body, "$.model"), ["x"]).alias("ours"))


def judge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as reviews: blank ones aren't asked about; every third answer is missing and degrades."""
    c = table(spark, sf_dir, "conversations").select(_text(F.col("conv_id"), "-", F.col("turn")).alias("trace_id"), F.when(F.col("turn") % 5 == 4, " \n").otherwise(F.col("text")).alias("review"), "turn")
    ask, none = judging.judge_inputs(c)
    answer = _text('{"claims":[{"id":"c1","file":"general","quote":', ledger.json_text(F.substring("review", 1, 9)), ',"summary":"s"},{"id":"c2","file":"f","quote":"q","summary":"s"}]}')
    answers = ask.where("turn % 3 <> 0").select("trace_id", answer.alias("answer"))
    back = judging.replayed(ask, answers)
    claims = judging.said_claims(back).groupBy("trace_id").agg(F.count("*").alias("claims"), F.min_by("quote", "pos").alias("quote"))
    out = back.join(claims, "trace_id", "left").select("trace_id", "degraded", F.coalesce("claims", F.lit(0)).cast("long").alias("claims"), "quote")
    return out.unionByName(none.select("trace_id", F.lit(False).alias("degraded"), F.lit(0).cast("long").alias("claims"), F.lit(None).cast("string").alias("quote")))


def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matchers' answers as verdict rows, one answer for each order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    one = lambda i, kind, rest: _text('{"claim_id":"c', str(i), '","kind":"', kind, '"', rest, "}")
    answer = _text('{"verdicts":[', one(1, "Matched", _text(',"defect_id":"d', k % 4, '","status":"full"')), F.when(k % 3 == 0, "").otherwise(_text(",", one(2, "false_alarm", F.lit(',"unsure":true')))), "]}")
    v = judging.said_verdicts(o.select(k.alias("trace_id"), answer.alias("answer")).distinct())
    return v.select("trace_id", F.col("pos").cast("long").alias("pos"), "claim_id", "kind", "defect_id", "status", "unsure")


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of two registered rewards."""
    registry = judging.Registry()
    registry.reward("half")(lambda traces: traces.select("trace_id", (F.col("o_custkey") % 2 / 2).alias("value")))
    registry.reward("some")(lambda traces: traces.where("o_custkey % 3 = 0").select("trace_id", F.lit(1.0).alias("value")))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("trace_id")).agg(F.min("o_custkey").alias("o_custkey"))
    return registry.total(o)


def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that lines of code load and bind."""
    k = F.col("p_partkey") % 97
    code = F.when(k % 3 == 0, _text("v", k, " = f", k, "(w, 'text')")).when(k % 3 == 1, _text("from m", k, " import a as b", k)).otherwise(_text("def g", k, "(p, q=r", k, "): return p"))
    rows = table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))
    said = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select("p_partkey", said(names.used_names("code")).alias("used"), said(names.bound_names("code")).alias("bound"), said(names.parameter_names("code")).alias("parameters"), T.looks_like_binding(F.col("code")).alias("binding"))


# decomposition


def made_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, diff, context, gold (struct): suppliers as tasks with four defects in three files; two of
    them share a hunk of c.py."""
    k = F.col("k")
    s = bridge.dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k", GOLDS)
    file = lambda p, hunk: _text(f"diff --git a/{p} b/{p}\nindex 1..2 100644\n--- a/{p}\n+++ b/{p}\n", hunk, "\n")
    a = _text("@@ -1,3 +1,3 @@\n keep\n-old = ", k, "\n+new = ", k, "\n tail")
    b = _text("@@ -10,2 +10,3 @@\n x\n+", F.when(k % 3 == 0, "call(1").otherwise("value = 2"), "\n y")
    c = "@@ -1,7 +1,7 @@\n l1\n-a\n+A = 1\n l3\n l4\n l5\n-b\n+B = 2\n l7"
    diff = F.concat(file("a.py", a), file("b.py", b), file("c.py", F.lit(c)))
    defect = lambda n, category, path, lo: F.struct(F.lit(f"d{n}").alias("id"), F.lit(category).alias("category"), F.lit(path).alias("file"), F.array(F.lit(lo), F.lit(lo)).alias("lines"), _text("s", k).alias("summary"), F.lit("r").alias("rationale"))
    other = lambda n, path, lines: F.struct(F.lit(f"x{n}").alias("id"), F.lit(path).alias("file"), lines.alias("lines"), F.lit(f"c{n}").alias("concern"), F.lit("w").alias("why_ok"))
    none = F.lit(None).cast("array<int>")
    extra = F.when(k % 2 == 0, F.array(other(1, "b.py", none), other(2, "a.py", F.array(F.lit(1), F.lit(1))), other(3, "b.py", none))).otherwise(F.array(other(1, "c.py", none), other(2, "c.py", none)))
    gold = F.to_json(F.struct(
        _text("t", k).alias("id"), F.lit("hard").alias("difficulty"), F.struct(F.lit("synthetic").alias("kind")).alias("source"),
        F.array(defect(1, "data", "a.py", 2), defect(2, "security", "b.py", 11), defect(3, "injection", "c.py", 2), defect(4, "resilience", "c.py", 6)).alias("defects"), extra.alias("distractors"), F.lit("notes").alias("prompt_notes"),
    ), {"ignoreNullFields": "false"})
    context = F.lit("About a.py.\n\nAbout b.py and c.py.\n\nOnly c.py.\n\nNone.")
    rows = s.select(_text("t", k).alias("directory"), diff.alias("diff"), context.alias("context"), gold.alias("gold"))
    return contracts.strict(contracts.validate_gold(rows)).where("valid").select(F.col("directory").alias("task_id"), "diff", "context", "gold")


def decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = subtasks.decompose(made_tasks(spark, sf_dir))
    lines = F.array_join(F.col("gold.defects")[0]["lines"], ",")
    return d.select(
        "id", "parent", "parent_defect", F.sha2("diff", 256).alias("diff_sha256"), "context", "status", "reason", "shared", F.col("gold.id").alias("gold_id"), F.col("gold.difficulty").alias("difficulty"),
        F.col("gold.defects")[0]["id"].alias("defect_id"), F.col("gold.defects")[0]["category"].alias("category"), F.col("gold.defects")[0]["file"].alias("path"), lines.alias("lines"),
        F.array_join(F.transform("gold.distractors", lambda x: F.concat(x["id"], x["concern"])), ",").alias("distractors"), F.col("gold.prompt_notes").alias("notes"),
    )


def subtask_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer lets through, and the golds as it writes them. The license of every seventh
    parent isn't permissive."""
    t = made_tasks(spark, sf_dir)
    bad = F.create_map(*[F.lit(x) for x in ("kind", "oss", "url", "u", "license", "GPL-3.0", "attribution", "a")])
    t = t.withColumn("gold", F.col("gold").withField("source", F.when(F.substring("task_id", 2, 9).cast("int") % 7 == 0, bad).otherwise(F.col("gold.source"))))
    rows = checked(subtasks.decompose(t))
    return rows.select("id", "valid", F.coalesce(F.try_element_at("violations", F.lit(1)), F.lit("")).alias("reason"), F.sha2(subtasks.gold_json(F.col("gold")), 256).alias("gold_sha256"))


def gold_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.gold_view(made_tasks(spark, sf_dir)).select("task_id", F.sha2("gold_view", 256).alias("view_sha256"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks from templates: a line replaced, one inserted or one deleted."""
    k = F.col("p_partkey")
    base = _text("one\ntwo ", k, "\nthree\nfour")
    changed = F.when(k % 3 == 0, _text("one\nTWO ", k, "\nthree\nfour")).when(k % 3 == 1, _text("one\ntwo ", k, "\nnew\nthree\nfour")).otherwise(F.lit("one\nthree\nfour"))
    t = table(spark, sf_dir, "part").select(
        _text("t", k).alias("id"), F.when(k % 2 == 0, "medium").alias("difficulty"), F.when(k % 5 == 0, "fam").alias("family"), F.lit("d1").alias("defect_id"), F.lit("data").alias("category"), F.lit("f.py").alias("file"),
        F.array(F.lit(2), F.lit(3)).alias("lines"), F.lit("s").alias("summary"), F.lit("r").alias("rationale"), F.lit("ctx").alias("context"), F.create_map(F.lit("f.py"), base).alias("base"), F.create_map(F.lit("f.py"), changed).alias("defective"),
    )
    g = subtasks.generate(t)
    return g.select("id", "diff", "family", F.col("gold.difficulty").alias("difficulty"), F.array_join(F.col("gold.defects")[0]["lines"], ",").alias("lines"), F.size("gold.distractors").cast("long").alias("distractors"))


# files


def _on_driver(path: str) -> str:
    """A path of the shared folder for the driver's own writers, which know local files only."""
    return path.removeprefix("file://").removeprefix("file:")


def loaded_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as task folders, written and read again."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    gold = F.to_json(F.struct(
        _text("t00", F.col("k"), "-x").alias("id"), F.lit("easy").alias("difficulty"), F.struct(F.lit("synthetic").alias("kind")).alias("source"),
        F.array(F.struct(F.lit("d1").alias("id"), F.lit("data").alias("category"), _text(" f", F.col("k"), ".py ").alias("file"), F.array(F.lit(1), F.lit(1)).alias("lines"), F.col("name").alias("summary"), F.lit("r: #1").alias("rationale"))).alias("defects"),
        F.array().cast("array<string>").alias("distractors"), F.when(F.col("k") % 2 == 0, F.col("name")).alias("prompt_notes"),
    ))
    path = _text("f", F.col("k"), ".py")
    diff = _text("diff --git a/", path, " b/", path, "\n--- a/", path, "\n+++ b/", path, "\n@@ -1,1 +1,1 @@\n-old\n+new ", F.col("name"), "\n")
    rows = contracts.validate_gold(r.select(_text("t00", F.col("k"), "-x").alias("directory"), gold.alias("gold"), diff.alias("diff"), _text("About ", F.col("name"), "\n").alias("context"), F.lit("clean").alias("status"), F.lit("p").alias("parent")))
    root = _on_driver(folder(spark, "tasks"))
    write_folders(contracts.quarantine(rows)[0].withColumn("id", F.col("directory")), root)
    loaded = tasks.load_tasks(spark, root).join(tasks.task_meta(spark, root).withColumnRenamed("directory", "task_id"), "task_id")
    one = F.col("gold.defects")[0]
    return loaded.select("task_id", F.array_join("file_list", ",").alias("files"), F.sha2("prompt", 256).alias("prompt_sha256"), F.trim(one["file"]).alias("file"), F.array_join(one["lines"], ",").alias("lines"), one["rationale"].alias("rationale"), "status", "parent", "generator")


def read_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of made_lines as two run folders, with blank lines, read again."""
    lines, root = made_lines(spark, sf_dir), folder(spark, "runs")
    names = ["env--prov--beta--h--1", "plain"]
    for name in names:
        own = lines.where(F.col("run") == name).withColumn("line", F.when(F.col("line_no") % 9 == 0, F.concat("line", F.lit("\n  \n"))).otherwise(F.col("line")))
        own.select("line").write.text(f"{root}/{name}/traces.jsonl")
    return rollouts(spark, [f"{root}/{n}" for n in names]).select("run", "run_ord", F.col("trace_pos").cast("long").alias("trace_pos"), "model", "task_id", "f1")


def read_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as template files; a prompt file beside them gives its text and version."""
    root = Path(_on_driver(folder(spark, "templates")))
    root.mkdir(parents=True)
    rows = table(spark, sf_dir, "region").collect()  # a table of five rows
    for r in rows:
        said = {"id": f"t00{r['r_regionkey']}-x", "difficulty": "easy", "family": "fam", "defect_id": "d1", "category": "data", "file": "f.py", "lines": [1, 2], "summary": r["r_name"], "rationale": "r", "context": "c"}
        said |= {"base": {"f.py": f"a\nb\n{r['r_name']}"}, "defective": {"f.py": f"a\nb: #\n{r['r_name']}"}}
        (root / f"{r['r_name']}.yaml").write_text(json.dumps(said))
    (root / "extractor.v3.md").write_text("Find: claims\n")
    made_ = subtasks.generate(tasks.templates(spark, f"{root}/*.yaml"))
    prompt = tasks.prompt_text(spark, str(root), "extractor.v3")
    return made_.select("id", "diff", F.col("gold.defects")[0]["summary"].alias("summary"), prompt.alias("prompt"), T.stem(F.lit(f"{root}/extractor.v3.md")).alias("version"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        diff_parse, diff_emit, diff_paths, hunk_headers, line_conflicts, gold_violations, gold_quarantine, claim_violations, rate_violations, zero_claims, trace_lines, model_order, report_lines, significance_lines,
        verdict_keys, gold_versions, request_prompts, judge_replay, judge_verdicts, rewards, code_names, decomposed, subtask_gate, gold_views, generated, loaded_tasks, read_runs, read_templates,
    )}
