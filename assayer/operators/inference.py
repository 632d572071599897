"""Paired cluster bootstrap: how sure a difference of two models' mean F1 is."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import parent_task, population

DRAWS, SEED = 10_000, 20260824
TAIL = 0.025


def cells(rollouts: DataFrame) -> DataFrame:
    """population, scenario, model, total, n: all that the resampling needs to know."""
    task = F.col("task_id")
    return rollouts.groupBy(population(task).alias("population"), parent_task(task).alias("scenario"), "model").agg(F.sum("f1").alias("total"), F.count("f1").alias("n"))


def scenarios(cell: DataFrame) -> DataFrame:
    """population, scenario and its 0-based place among the sorted ones; a few rows a population."""
    own = Window.partitionBy("population")
    return cell.select("population", "scenario").distinct().select("population", "scenario", (F.row_number().over(own.orderBy("scenario")) - 1).alias("place"), F.count("*").over(own).alias("size"))


def hashed_draws(spark: SparkSession, known: DataFrame, draws: int) -> DataFrame:
    """population, draw, scenario: draws from arithmetic on (draw, slot), the same in any engine. Each
    scenario is a slot of every draw of its population."""
    slots = known.select("population", F.col("place").alias("slot"), "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw"))
    pick = F.pmod((F.col("draw") * 7919 + F.col("slot") * 104729 + 12345) * 48271 % 2147483647, F.col("size"))
    return slots.select("population", "draw", pick.alias("place")).join(known.select("population", "place", "scenario"), ["population", "place"]).drop("place")


def seeded_draws(spark: SparkSession, known: DataFrame, paired: list[str], draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """The same from one seeded generator on the driver, curated scenarios first; populations that are
    not paired take no numbers. Its size is draws times scenarios, whatever the corpus."""
    rng, rows = random.Random(seed), []
    names: dict[str, list[str]] = {}
    for r in known.orderBy("population", "place").collect():
        names.setdefault(r["population"], []).append(r["scenario"])
    for which in ("curated", "sub-tasks"):
        if which in paired:
            rows += [(which, i, rng.choice(names[which])) for i in range(draws) for _ in names[which]]
    return spark.createDataFrame(rows, "population string, draw long, scenario string")


def _gap(a: str, b: str) -> Column:
    mean = lambda m: F.sum(F.when(F.col("model") == m, F.col("total"))) / F.nullif(F.sum(F.when(F.col("model") == m, F.col("n"))), F.lit(0))
    return mean(a) - mean(b)


def observed_gap(cell: DataFrame, a: str, b: str) -> DataFrame:
    return cell.groupBy("population").agg(_gap(a, b).alias("gap"), F.countDistinct("scenario").alias("scenarios"))


def gaps(cell: DataFrame, drawn: DataFrame, a: str, b: str) -> DataFrame:
    """population, draw, gap for the draws in which both models have rollouts. A scenario drawn k times
    counts k times. Both models come from one pass."""
    pair = cell.where(F.col("model").isin(a, b))
    joined = drawn.join(pair, ["population", "scenario"])
    return joined.groupBy("population", "draw").agg(_gap(a, b).alias("gap")).where("gap IS NOT NULL")


def interval(gap: DataFrame, digits: int | None = None) -> DataFrame:
    """population, n, lo, hi, ahead, separated. The ends are the draws of 0-based rank floor(q * n):
    no percentile function picks those."""
    value = F.round("gap", digits) if digits is not None else F.col("gap")
    own = Window.partitionBy("population")
    ranked = gap.withColumn("gap", value).select("population", "gap", (F.row_number().over(own.orderBy("gap")) - 1).alias("rank"), F.count("*").over(own).alias("n"))
    at = lambda q: F.max(F.when(F.col("rank") == F.floor(F.lit(q) * F.col("n")), F.col("gap")))
    out = ranked.groupBy("population").agg(F.max("n").alias("n"), at(TAIL).alias("lo"), at(1 - TAIL).alias("hi"), F.avg((F.col("gap") > 0).cast("int")).alias("ahead"))
    return out.withColumn("separated", (F.col("lo") > 0) | (F.col("hi") < 0))


def bootstrap(spark: SparkSession, rollouts: DataFrame, a: str, b: str, draws: int = DRAWS, seed: int | None = SEED) -> DataFrame:
    """population, scenarios, gap, lo, hi, ahead, separated; populations without paired rollouts have
    no row. With seed None the draws are arithmetic and nothing is collected."""
    cell = cells(rollouts)
    seen = observed_gap(cell, a, b).where("gap IS NOT NULL")
    known = scenarios(cell)
    drawn = hashed_draws(spark, known, draws) if seed is None else seeded_draws(spark, known, [r[0] for r in seen.select("population").collect()], draws, seed)
    return seen.join(interval(gaps(cell, drawn, a, b)), "population")


def sentence(row) -> str:
    verdict = "separated" if row["separated"] else "not separated at 95%"
    return f"{row['population']}: {row['scenarios']} scenarios, gap {row['gap']:+.3f}, 95% CI [{row['lo']:+.3f}, {row['hi']:+.3f}], P(ahead) {row['ahead']:.2f} — {verdict}"
