"""Scores of reviews from verdicts: recall, precision, F1 and recall by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Marker of the precision formula that counts distractor hits as false alarms.
FORMULA = 2.0


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def credits(verdicts: DataFrame) -> DataFrame:
    """trace_id, pos, status, defect_id, duplicate: a row for each credit of a matched verdict (one with
    null defect_id if it has none). A verdict is a duplicate if all its credits were fully credited
    by verdicts before it; it can't change what is credited, so the first full credit decides."""
    given = verdicts.where("kind = 'matched'").select("trace_id", "pos", "status", F.explode_outer(F.array_compact(F.array("defect_id", "second_defect_id"))).alias("defect_id"))
    of_defect = Window.partitionBy("trace_id", "defect_id")
    of_verdict = Window.partitionBy("trace_id", "pos")
    first = F.min(F.when(F.col("status") == "full", F.col("pos"))).over(of_defect)
    spent = F.col("defect_id").isNull() | F.coalesce(first < F.col("pos"), F.lit(False))
    return given.withColumn("_spent", spent).withColumn("duplicate", F.bool_and("_spent").over(of_verdict)).drop("_spent")


def credited(given: DataFrame) -> DataFrame:
    """trace_id, defect_id, credit: 1.0 if fully credited anywhere, else 0.5."""
    live = given.where(~F.col("duplicate") & F.col("defect_id").isNotNull())
    return live.groupBy("trace_id", "defect_id").agg(F.when(F.bool_or(F.col("status") == "full"), 1.0).otherwise(0.5).alias("credit"))


#: What is counted of a trace's verdicts.
COUNTS = ("distractor_hits", "false_alarms", "review_required", "duplicate", "matched")


def tallies(verdicts: DataFrame) -> DataFrame:
    """trace_id, the COUNTS of its verdicts, and credits: an array of (defect_id, credit), as many as
    defects are credited."""
    matched = F.col("kind") == "matched"
    given = F.when(matched, F.array_compact(F.array("defect_id", "second_defect_id"))).otherwise(F.array().cast("array<string>"))
    rows = verdicts.select("trace_id", "pos", "kind", "status", F.coalesce("unsure", F.lit(False)).alias("unsure"), F.posexplode_outer(given).alias("nth", "defect_id"))
    first = F.min(F.when(F.col("status") == "full", F.col("pos"))).over(Window.partitionBy("trace_id", "defect_id"))
    rows = rows.withColumn("spent", F.col("defect_id").isNull() | F.coalesce(first < F.col("pos"), F.lit(False)))
    rows = rows.withColumn("again", F.bool_and("spent").over(Window.partitionBy("trace_id", "pos")))
    lead = F.coalesce("nth", F.lit(0)) == 0  # of the rows of one verdict the first counts
    each = rows.groupBy("trace_id", "defect_id").agg(
        F.count_if(F.col("kind") == "distractor").alias("distractor_hits"),
        F.count_if(F.col("kind") == "false_alarm").alias("false_alarms"),
        F.count_if(lead & F.col("unsure")).alias("review_required"),
        F.count_if(lead & matched & F.col("again")).alias("duplicate"),
        F.count_if(lead & matched & ~F.col("again")).alias("matched"),
        F.max(F.when(F.col("defect_id").isNotNull() & ~F.col("again"), F.when(F.col("status") == "full", 1.0).otherwise(0.5))).alias("credit"),
    )
    credit = F.when(F.col("credit").isNotNull(), F.struct("defect_id", "credit"))
    return each.groupBy("trace_id").agg(*[F.sum(c).alias(c) for c in COUNTS], F.collect_list(credit).alias("credits"))


def category_recall(traces: DataFrame, defects: DataFrame, given: DataFrame) -> DataFrame:
    """trace_id, category, recall over the category's defects."""
    gold = traces.join(defects, "task_id").select("trace_id", "defect_id", "category").distinct()
    both = gold.join(credited(given), ["trace_id", "defect_id"], "left")
    return both.groupBy("trace_id", "category").agg((F.sum(F.coalesce("credit", F.lit(0.0))) / F.count("*")).alias("recall"))


def score_reviews(traces: DataFrame, defects: DataFrame, claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row for each trace (trace_id, task_id) with its metrics.

    defects: task_id, defect_id (text), category. claims: trace_id, claim_id. verdicts: trace_id, pos (their
    order decides duplicates), kind, defect_id, second_defect_id, status, unsure. A review without
    claims has recall 0, precision 1, F1 0 and no categories. Verdicts are dealt by trace_id once; every
    window and count on the way keeps to that.
    """
    n_claims = claims.groupBy("trace_id").agg(F.count("*").alias("claim_count"))
    gold = defects.groupBy("task_id").agg(F.collect_set(F.struct("defect_id", "category")).alias("gold"), F.countDistinct("defect_id").alias("n_defects"))
    out = traces.join(gold, "task_id", "left").join(n_claims, "trace_id", "left").join(tallies(verdicts), "trace_id", "left")
    out = out.fillna(0, ["n_defects", "claim_count", *COUNTS])
    found = F.coalesce("credits", F.array().cast("array<struct<defect_id:string,credit:double>>"))
    out = out.withColumn("credit", F.aggregate(found, F.lit(0.0), lambda s, x: s + x["credit"])).withColumn("by_defect", F.map_from_entries(found))
    of = lambda c: F.filter("gold", lambda g: g["category"] == c)
    total = lambda c: F.aggregate(of(c), F.lit(0.0), lambda s, g: s + F.coalesce(F.col("by_defect")[g["defect_id"]], F.lit(0.0)))
    categories = F.array_sort(F.array_distinct(F.transform("gold", lambda g: g["category"])))
    out = out.withColumn("per_category", F.map_from_entries(F.transform(categories, lambda c: F.struct(c, total(c) / F.size(of(c))))))
    none = F.col("claim_count") == 0
    scoreable = F.col("claim_count") - F.col("duplicate")
    recall = F.when(none, 0.0).when(F.col("n_defects") == 0, 1.0).otherwise(F.col("credit") / F.greatest("n_defects", F.lit(1)))
    precision = F.when(none | (scoreable <= 0), 1.0).otherwise(F.col("matched") / F.greatest(scoreable, F.lit(1)))
    out = out.withColumn("recall", recall).withColumn("precision", precision)
    out = out.withColumn("f1", F.when(none, 0.0).otherwise(f1(F.col("precision"), F.col("recall"))))
    empty = F.create_map().cast("map<string,double>")
    zero = lambda c: F.when(none, 0).otherwise(F.col(c)).cast("long").alias(c)
    return out.select(
        "trace_id", "task_id", "recall", "precision", "f1", zero("distractor_hits"), zero("false_alarms"), "claim_count", zero("duplicate"), "review_required",
        F.when(none, empty).otherwise(F.coalesce("per_category", empty)).alias("per_category"),
    )


def metrics(scores: DataFrame) -> DataFrame:
    """trace_id and metrics, the flat map that a trace records."""
    names = ("recall", "precision", "distractor_hits", "false_alarms", "claim_count", "duplicate", "review_required")
    fixed = F.create_map(F.lit("scoring_formula"), F.lit(FORMULA), *[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    by = F.transform_keys("per_category", lambda k, _: F.concat(F.lit("recall_"), k))
    return scores.select("trace_id", F.map_concat(fixed, by).alias("metrics"))
