"""Run analytics: rescoring of stored rollouts, and reports by task and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import population
from .scoring import f1

#: Metrics that the correction needs; without one of them a rollout keeps its recorded score.
NEEDED = ("claim_count", "distractor_hits", "duplicate", "recall", "precision")
DETAIL = ("recall", "precision", "claim_count", "false_alarms", "distractor_hits")


def rescored(metrics: Column, recorded: Column) -> Column:
    """(f1, precision) under the formula that counts distractor hits: what was matched follows from the
    old precision and its denominator. Marked rollouts, those without claims and those that lack a
    metric keep what they recorded. The rounding is half to even."""
    m = {n: metrics[n] for n in NEEDED}
    keep = F.coalesce(metrics["scoring_formula"], F.lit(1.0)) >= 2.0
    for v in m.values():
        keep = keep | v.isNull()
    before = m["claim_count"] - m["distractor_hits"] - m["duplicate"]
    matched = F.when(before > 0, F.rint(m["precision"] * before)).otherwise(0.0)
    now = m["claim_count"] - m["duplicate"]
    precision = F.when(now <= 0, 1.0).otherwise(matched / F.when(now > 0, now).otherwise(1.0))
    old = F.struct(recorded.alias("f1"), F.coalesce(m["precision"], F.lit(0.0)).alias("precision"))
    new = F.struct(f1(precision, m["recall"]).alias("f1"), precision.alias("precision"))
    return F.when(keep | (m["claim_count"] == 0), old).otherwise(new)


def rescore(rollouts: DataFrame) -> DataFrame:
    """rollouts (with metrics and f1) with f1 and metrics['precision'] corrected."""
    done = rollouts.withColumn("_new", rescored(F.col("metrics"), F.col("f1")))
    rest = F.map_filter(F.coalesce("metrics", F.create_map().cast("map<string,double>")), lambda k, _: k != "precision")
    return done.withColumn("f1", F.col("_new.f1")).withColumn("metrics", F.map_concat(rest, F.create_map(F.lit("precision"), F.col("_new.precision")))).drop("_new")


def model_order(rollouts: DataFrame) -> DataFrame:
    """model, place: models in the order in which the runs first name them."""
    first = rollouts.groupBy("model").agg(F.min(F.struct("run_ord", "line_no", "trace_pos")).alias("first"))
    return first.select("model", F.row_number().over(Window.orderBy("first")).alias("place"))  # one row for each model


def by_task_and_model(rollouts: DataFrame) -> DataFrame:
    return rollouts.withColumn("population", population(F.col("task_id"))).groupBy("population", "task_id", "model").agg(F.avg("f1").alias("f1"), F.count("*").alias("rollouts"))


def pivoted(rollouts: DataFrame, models: list[str]) -> DataFrame:
    """population, task_id and a column of mean F1 for each model (null: none)."""
    return rollouts.withColumn("population", population(F.col("task_id"))).groupBy("population", "task_id").pivot("model", models).agg(F.avg("f1"))


def grand_mean(rollouts: DataFrame) -> DataFrame:
    """The mean over rollouts, not over the tasks' means."""
    return rollouts.withColumn("population", population(F.col("task_id"))).groupBy("population", "model").agg(F.avg("f1").alias("f1"), F.count("*").alias("rollouts"))


def detail(rollouts: DataFrame) -> DataFrame:
    """Means by population, model and task, with a row of null task for all of them. A metric that a
    rollout lacks counts as 0."""
    means = [F.avg(F.coalesce(F.col("metrics")[n], F.lit(0.0))).alias(n) for n in DETAIL]
    return rollouts.withColumn("population", population(F.col("task_id"))).groupingSets(
        [["population", "model", "task_id"], ["population", "model"]], "population", "model", "task_id"
    ).agg(F.avg("f1").alias("f1"), *means)


def _shown(value: float | None, digits: int = 2, bold: bool = False) -> str:
    if value is None:
        return "—"
    return f"**{value:.{digits}f}**" if bold else f"{value:.{digits}f}"


def _markdown(head: list[str], body: list[list[str]]) -> str:
    lines = [f"| {' | '.join(cells)} |" for cells in (head, *body)]
    return "\n".join([lines[0], "|" + "---|" * len(head), *lines[1:]])


def markdown_table(rollouts: DataFrame, which: str, models: list[str]) -> str:
    """The F1 table of a population; tasks times models cells reach the driver."""
    by_task = pivoted(rollouts, models).where(F.col("population") == which).orderBy("task_id").collect()
    whole = {r["model"]: r["f1"] for r in grand_mean(rollouts).where(F.col("population") == which).collect()}
    body = [[r["task_id"], *(_shown(r[m]) for m in models)] for r in by_task]
    return _markdown(["Task", *(f"{m} F1" for m in models)], [*body, ["**Mean**", *(_shown(whole.get(m), bold=True) for m in models)]])


#: Columns of the detail table: heading, metric, digits.
SHOWN = [("F1", "f1", 2), ("Recall", "recall", 2), ("Precision", "precision", 2), ("Claims", "claim_count", 1), ("False alarms", "false_alarms", 1), ("Distractor hits", "distractor_hits", 1)]


def markdown_detail(rollouts: DataFrame, which: str, model: str) -> str:
    """The means of one model by task, and over all of them last."""
    own = detail(rollouts).where((F.col("population") == which) & (F.col("model") == model))
    body = []
    for r in own.orderBy(F.col("task_id").asc_nulls_last()).collect():
        last = r["task_id"] is None
        body.append(["**Mean**" if last else r["task_id"], *(_shown(r[c], digits, bold=last and c == "f1") for _, c, digits in SHOWN)])
    return _markdown(["Task", *(head for head, _, _ in SHOWN)], body)
