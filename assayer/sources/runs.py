"""Reader of run folders: rollouts from nested JSON lines."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import resolved_model
from ..operators.runs import rescore

TRACE = "task struct<data:struct<task_id:string>>, traces array<struct<rewards:map<string,struct<score:double>>, agent:struct<model:string>, metrics:map<string,double>>>"


def run_lines(spark: SparkSession, runs: list[str], file: str = "traces.jsonl") -> DataFrame:
    """run, run_ord, line_no, line: a row for each line; blank ones are skipped. Large files are split,
    so a line's place is the start of its part of the file and its number in that part; the order of
    lines decides the order of models. Runs are in the order given, also where their names are equal."""
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"))
    parts = [
        spark.read.text(f"{run}/{file}").select(F.lit(run.rstrip("/").rpartition("/")[2]).alias("run"), F.lit(i).alias("run_ord"), at.alias("line_no"), F.col("value").alias("line"))
        for i, run in enumerate(runs)
    ]
    return functools.reduce(DataFrame.unionByName, parts).where(F.trim("line") != "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """run, run_ord, line_no, trace_pos, model, task_id, f1, metrics for each trace with an f1 reward. A
    malformed line is an error."""
    parsed = lines.withColumn("r", F.from_json("line", TRACE, {"mode": "FAILFAST"}))
    each = parsed.select("run", "run_ord", "line_no", F.col("r.task.data.task_id").alias("task_id"), F.posexplode("r.traces").alias("trace_pos", "t"))
    score = F.col("t.rewards")["f1"]["score"]
    kept = each.where(score.isNotNull())
    return kept.select("run", "run_ord", "line_no", "trace_pos", resolved_model(F.col("t.agent.model"), F.col("run")).alias("model"), "task_id", score.alias("f1"), F.coalesce("t.metrics", F.create_map().cast("map<string,double>")).alias("metrics"))


def rollouts(spark: SparkSession, runs: list[str]) -> DataFrame:
    """Rescored rollouts of all runs; both reports read this."""
    return rescore(parse_lines(run_lines(spark, runs)))
