"""Queries of the operators over generic tables, each a projection that two engines can compute.

Traces are a user's events of a day; tasks, models and diffs are derived from keys. The same
projections stand in oracle.py as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import contracts, diffs, inference, ledger, runs, scoring
from ..storage import stored

A, B = "m0", "m1"
DRAWS = inference.DRAWS
#: Passages (16 bytes each) that are broadcast to look for.
LEADS = 1_000_000
#: Rows that are dealt out to a task.
ROWS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(scan: DataFrame, rows: int | None = None) -> int:
    """How many parts of so many rows a plain scan makes; one for each core at least."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // (rows or ROWS)))


def dealt(scan: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """A plain scan dealt out by a key into parts of so many rows, so that what a task holds doesn't grow
    with the table. Adaptive execution joins parts by their compressed bytes, but leaves a given number."""
    return scan.repartition(parts(scan, rows), key)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _when(column: str, values: dict[str, object]) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as verdicts: trace = user and day, order = time; some credit one defect, some two."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyyMMdd")
    rows = e.select(F.concat_ws("-", "user_id", day).alias("trace_id"), "user_id", F.dayofmonth("ts").alias("day"), "ts", "event_id", "event_type")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("trace_id").orderBy("ts", "event_id")))
    defect = F.concat(F.lit("d"), (F.col("event_id") % 4 + 1).cast("string"))
    second = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0), F.concat(F.lit("d"), ((F.col("event_id") + 1) % 4 + 1).cast("string")))
    kind = _when("event_type", {"purchase": "matched", "click": "matched", "signup": "matched", "view": "distractor", "error": "false_alarm"})
    matched = F.col("event_type").isin("purchase", "click", "signup")
    return rows.select(
        "trace_id", "user_id", "day", "pos", F.col("event_id").cast("string").alias("claim_id"), kind.alias("kind"),
        F.when(matched, defect).alias("defect_id"), F.when(matched, second).alias("second_defect_id"),
        F.when(F.col("event_type") == "click", "partial").otherwise("full").alias("status"), (F.col("event_id") % 17 == 0).alias("unsure"),
    )


def traces(v: DataFrame) -> DataFrame:
    task = F.concat(F.lit("t00"), (F.col("day") % 6 + 1).cast("string"), F.when(F.col("user_id") % 2 == 1, "-d1").otherwise(""))
    model = F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))
    return v.groupBy("trace_id", "user_id", "day").agg(F.lit(1)).select("trace_id", task.alias("task_id"), model.alias("model"))


def golds(spark: SparkSession) -> DataFrame:
    """Four defects in three categories for each of the twelve tasks; a table of 48 rows."""
    tasks = spark.range(12).select(F.concat(F.lit("t00"), (F.col("id") % 6 + 1).cast("string"), F.when(F.col("id") >= 6, "-d1").otherwise("")).alias("task_id"))
    defects = F.array(*[F.struct(F.lit(f"d{i}").alias("defect_id"), F.lit(c).alias("category")) for i, c in enumerate(("concurrency", "data", "security", "data"), 1)])
    return tasks.select("task_id", F.inline(defects))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir)
    return scoring.score_reviews(traces(v).drop("model"), golds(spark), v.select("trace_id", "claim_id"), v)


def score_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).drop("per_category"), "recall", "precision", "f1")


def category_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir)
    return rounded(scoring.category_recall(traces(v).drop("model"), golds(spark), scoring.credits(v)), "recall")


def trace_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring.metrics(_scored(spark, sf_dir))
    return m.select("trace_id", F.explode("metrics").alias("metric", "value")).withColumn("value", F.round("value", 6))


def credit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.credited(scoring.credits(verdicts(spark, sf_dir)))


def duplicate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.credits(verdicts(spark, sf_dir)).groupBy("trace_id", "pos").agg(F.bool_or("duplicate").alias("duplicate"))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as rollouts recorded under the first formula, which left distractor hits out of the
    denominator, and rescored."""
    v = verdicts(spark, sf_dir)
    s = _scored(spark, sf_dir)
    left = F.col("claim_count") - F.col("duplicate") - F.col("distractor_hits")
    matched = F.col("claim_count") - F.col("duplicate") - F.col("distractor_hits") - F.col("false_alarms")
    old = F.when(left <= 0, 1.0).otherwise(matched / F.greatest(left, F.lit(1)))
    named = {"claim_count": F.col("claim_count"), "distractor_hits": F.col("distractor_hits"), "duplicate": F.col("duplicate"), "recall": F.col("recall"), "precision": old, "false_alarms": F.col("false_alarms")}
    metrics = F.create_map(*[x for k, c in named.items() for x in (F.lit(k), c.cast("double"))])
    base = s.select("trace_id", "task_id", metrics.alias("metrics"), scoring.f1(old, F.col("recall")).alias("f1"))
    return runs.rescore(base.join(traces(v).select("trace_id", "model"), "trace_id"))


def rescore_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollouts(spark, sf_dir)
    return r.select("trace_id", "task_id", "model", F.round("f1", 6).alias("f1"), F.round(F.col("metrics")["precision"], 6).alias("precision"))


def report_by_task_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.by_task_and_model(rollouts(spark, sf_dir)), "f1")


def report_grand_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.grand_mean(rollouts(spark, sf_dir)), "f1")


def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.pivoted(rollouts(spark, sf_dir), ["m0", "m1", "m2"]), "m0", "m1", "m2")


def report_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.detail(rollouts(spark, sf_dir)), "f1", *runs.DETAIL)


def bootstrap_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = inference.cells(rollouts(spark, sf_dir))
    drawn = inference.hashed_draws(spark, inference.scenarios(cell), DRAWS)
    return rounded(inference.gaps(cell, drawn, A, B), "gap")


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = inference.cells(rollouts(spark, sf_dir))
    drawn = inference.hashed_draws(spark, inference.scenarios(cell), DRAWS)
    return rounded(inference.interval(inference.gaps(cell, drawn, A, B), 6), "lo", "hi", "ahead")


def bootstrap_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.observed_gap(inference.cells(rollouts(spark, sf_dir)), A, B), "gap")


def bootstrap_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.bootstrap(spark, rollouts(spark, sf_dir), A, B)


def lineitems(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Lineitems as diff lines: key (the order), at (from 1), prefix, and what lines are made of. They
    are dealt out under the key's new name, so that what follows is by the same key."""
    by = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(key), *by, "l_linestatus", _when("l_returnflag", {"N": " ", "R": "-", "A": "+"}).alias("prefix"))
    return dealt(li, key).withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(*by)))


def hunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as diff lines: an order is a hunk, its return flags are prefixes."""
    rows = lineitems(spark, sf_dir, "hunk").select("hunk", (F.col("at") - 1).alias("pos"), "prefix", F.col("l_linestatus").alias("state"))
    rows = rows.withColumn("old_start", (F.col("hunk") % 50 + 1).cast("int")).withColumn("new_start", (F.col("hunk") % 70 + 1).cast("int"))
    return diffs.numbered(rows, ["hunk"])


def hunk_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunk_lines(spark, sf_dir).select("hunk", "pos", "prefix", "old_no", "new_no")


def line_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.positioned(hunk_lines(spark, sf_dir), ["hunk"]).select("hunk", "pos", "place")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hunk_lines(spark, sf_dir).withColumn("kept", F.col("state") == "O").withColumn("text", F.lit("x")).withColumn("old_count", F.lit(0)).withColumn("new_count", F.lit(0))
    return diffs.split_runs(rows, ["hunk"])


def hunk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    return r.select("hunk", F.element_at("lines", 1)["pos"].cast("long").alias("first_pos"), "old_count", "new_count", F.size("lines").cast("long").alias("n_lines"))


def context_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hunk_lines(spark, sf_dir).withColumn("owned", (F.col("state") == "O") & (F.col("prefix") != " "))
    return diffs.with_context(rows, ["hunk"]).where("kept").select("hunk", "pos")


def line_span_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    lo = (F.col("o_custkey") % 5 + F.col("o_orderkey") % 70 + 1).cast("int")
    spans = o.select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("d"), (F.col("o_custkey") % 4 + 1).cast("string")).alias("defect_id"), F.lit("f").alias("path"), lo.alias("lo"), (lo + 3).alias("hi"))
    lines = diffs.positioned(hunk_lines(spark, sf_dir), ["hunk"]).withColumn("task_id", F.col("hunk")).withColumn("path", F.lit("f"))
    return owned(spark, sf_dir, lines, spans).select("hunk", "pos", "defect_id")


def owned(spark: SparkSession, sf_dir: str, lines: DataFrame, spans: DataFrame) -> DataFrame:
    """owners() of lineitems as lines; both sides are dealt out as lineitems are."""
    n = parts(table(spark, sf_dir, "lineitem"))
    return diffs.owners(lines.repartition(n, "task_id", "path"), spans.repartition(n, "task_id", "path"))


def gold_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("hunk").orderBy("run")))
    return diffs.anchors(r, ["hunk"])


def verbatim_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages found verbatim in documents, also within words. Of a passage of six words or
    more the second to the fifth stand whole in the document; their hash leads to it, so that not every
    pair is compared. Up to LEADS passages go to all tasks and documents stay where they are read; more are
    joined by their hashes. Shorter passages are compared with every document."""
    b = table(spark, sf_dir, "benchmark").select("item_id", T.verbatim(F.col("text")).alias("quote")).withColumn("parts", F.split("quote", " "))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = d.select("doc_id", F.split(F.replace("text", F.lit("`"), F.lit("")), r"(?U)\s+").alias("words"))
    # the lambda reads its element only: an array from outside would be made anew for each element
    near = F.arrays_zip(F.col("words").alias("w0"), *[F.slice("words", F.lit(i + 1), F.size("words")).alias(f"w{i}") for i in (1, 2, 3)])
    leads = words.select("doc_id", F.array_distinct(F.transform(near, lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(4)]))).alias("leads"))
    long = b.where(F.size("parts") >= 6).withColumn("lead", F.xxhash64(*[F.get("parts", F.lit(i)) for i in range(1, 5)]))
    known = long.select("item_id", "lead")
    known = F.broadcast(known) if known.count() <= LEADS else known
    found = leads.select("doc_id", F.explode("leads").alias("lead")).join(known, "lead").select("doc_id", "item_id")
    # only documents that a lead hits are normalised; the written pairs tell the planner their size
    hit = d.join(stored(found.distinct(), "leads"), "doc_id").join(long.select("item_id", "quote"), "item_id")
    inside = F.contains(T.verbatim(F.col("text")), "quote")
    short = d.select("doc_id", T.verbatim(F.col("text")).alias("said")).join(b.where(F.size("parts") < 6).select("item_id", "quote"), F.contains("said", "quote"))
    return hit.where(inside).select("doc_id", "item_id").unionByName(short.select("doc_id", "item_id")).distinct()


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as traces and lineitems as verdicts: every rule has rows that break it."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tr = o.select(F.col("o_orderkey").alias("trace_id"), (F.col("o_orderkey") % 6).alias("task_id")).distinct()
    claims = tr.select("trace_id", F.explode(F.sequence(F.lit(1), (F.col("trace_id") % 3 + 2).cast("int"))).alias("claim_id"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    v = li.select(
        F.col("l_orderkey").alias("trace_id"), F.row_number().over(order).alias("pos"), F.col("l_linenumber").alias("claim_id"),
        F.when(F.col("l_partkey") % 23 == 0, "other").otherwise(_when("l_returnflag", {"N": "matched", "R": "distractor", "A": "false_alarm"})).alias("kind"),
        F.when(F.col("l_partkey") % 11 != 0, (F.col("l_partkey") % 5).cast("int")).alias("defect_id"),
        F.when(F.col("l_suppkey") % 3 == 0, (F.col("l_suppkey") % 5).cast("int")).alias("second_defect_id"),
        (F.col("l_suppkey") % 4).cast("int").alias("distractor_file"),
    )
    tasks = spark.range(6)
    defects = tasks.select(F.col("id").alias("task_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("defect_id"))
    files = tasks.select(F.col("id").alias("task_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("file"))
    found = contracts.validate_verdicts(tr, claims, v, defects, files)
    return found.select("trace_id", "valid", F.size("violations").cast("long").alias("n"), F.try_element_at("violations", F.lit(1)).alias("first"))


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(F.lit("c"), (x["turn"] + 1).cast("string")))
    return c.groupBy("conv_id").agg(ids.alias("ids")).select("conv_id", contracts.dense(F.col("ids"), "c").alias("dense"), F.size("ids").cast("long").alias("turns"))


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n\n")
    return c.groupBy("conv_id").agg(said.alias("prompt")).select("conv_id", F.sha2("prompt", 256).alias("prompt_sha256"), T.estimated_tokens(F.col("prompt")).cast("long").alias("tokens"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("turns"))


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    usage = c.select("conv_id", "turn", F.col("role").alias("model"), (T.estimated_tokens(F.col("text")) * 100).alias("input_tokens"), T.estimated_tokens(F.col("text")).alias("output_tokens"))
    rates = c.select(F.col("role").alias("model")).distinct().select("model", (F.length("model") * 10.0).alias("input_per_1m"), (F.length("model") * 50.0).alias("output_per_1m"))
    return ledger.running_budget(ledger.priced(usage, rates), ["conv_id"], ["turn"], 1.0, 2.0)


def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_budget(spark, sf_dir).select("conv_id", "turn", "cost", "spent", "remaining"), "cost", "spent", "remaining")


def budget_hard_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _budget(spark, sf_dir).withColumn("exceeded", F.round("spent", 6) >= 2.0)
    return ledger.stopped_at(b, ["conv_id"], "turn")


def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("content_sha256"), ledger.native_key(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("short_key"))


def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ledger.review_hash(F.col("text")).alias("review_hash"))


def context_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs, two words as the files that they name."""
    d = table(spark, sf_dir, "documents")
    kept = T.pruned_context(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("the"), F.array(F.lit("ing"), F.lit("tion")))
    return d.select("doc_id", F.sha2(kept, 256).alias("kept_sha256"), F.length(kept).cast("long").alias("kept_chars"))


def delimiter_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.delimiter_balance(F.col("text")).cast("long").alias("balance"))


def label_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality 0 as a guess at toxic 1."""
    n = table(spark, sf_dir, "labels").agg(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("hit"), F.count_if(F.col("quality") == 0).alias("said"), F.count_if(F.col("toxic") == 1).alias("gold"))
    p, r = F.try_divide("hit", "said"), F.try_divide("hit", "gold")
    one = n.select("hit", "said", "gold", F.coalesce(p, F.lit(1.0)).alias("precision"), F.coalesce(r, F.lit(1.0)).alias("recall"))
    return rounded(one.withColumn("f1", scoring.f1(F.col("precision"), F.col("recall"))), "precision", "recall", "f1")


def model_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    run = F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws("--", F.lit("env"), F.lit("prov"), "n_name", F.lit("h"))).otherwise(F.concat_ws("--", F.lit("env"), "n_name"))
    return n.select("n_nationkey", T.model_of(run).alias("model"), T.resolved_model(F.when(F.col("n_regionkey") == 0, F.lit("")).otherwise(F.lit("given")), run).alias("resolved"), T.parent_task(F.concat("n_name", F.lit("-d"), F.col("n_nationkey").cast("string"))).alias("parent"), T.stem(F.concat(F.lit("/a/b/"), "n_name", F.lit(".v2.md"))).alias("stem"))


def diff_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    diff = F.concat(F.lit("diff --git a/z b/z\n--- /dev/null\n+++ b/z/"), "r_name", F.lit("\n@@ -0,0 +1 @@\n+x\n--- a/a/"), "r_name", F.lit("\n+++ b/z/"), "r_name", F.lit("\n"))
    return r.select("r_regionkey", F.array_join(T.diff_files(diff), ",").alias("files"))


def text_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimming, folding, fences and prompts over conversation turns."""
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("\t```json\n"), "text", F.lit("\n```  "))
    return c.select(
        "conv_id", "turn", F.sha2(T.strip_fences(said), 256).alias("bare"), T.fold_kind(F.upper("role")).alias("kind"), F.sha2(T.verbatim(F.concat(F.lit(" `"), "text", F.lit("` \n"))), 256).alias("normal"),
        F.sha2(T.review_prompt(F.col("text"), F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.col("role")), F.lit("d")), 256).alias("prompt"), F.size(T.identifiers(F.col("text"))).cast("long").alias("identifiers"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        score_review, category_recall, trace_metrics, credit_state, duplicate_verdicts, rescore_rollouts, report_by_task_model, report_grand_mean, report_pivot, report_detail,
        bootstrap_gap, bootstrap_interval, bootstrap_observed, bootstrap_seeded, hunk_line_numbers, line_places, hunk_runs, context_kept, line_span_ownership, gold_anchor,
        verbatim_containment, contract_violations, dense_ids, prompt_assembly, token_estimate, budget_running, budget_hard_stop, content_keys, canonical_keys, context_prune,
        delimiter_balance, label_precision_recall, model_from_path, diff_file_list, text_seams,
    )}
