"""Readers of task folders (YAML, Markdown and diffs), templates and prompts."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.contracts import strict, validate_gold
from ..functions.text import diff_files, review_prompt

FILES = ["diff.patch", "context.md", "gold.yaml"]
TASKS = "t[0-9][0-9][0-9]-*"
TEMPLATE = "id string, difficulty string, family string, defect_id string, category string, file string, lines array<int>, summary string, rationale string, context string, base map<string,string>, defective map<string,string>"


def yaml_to_json(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    return json.dumps(yaml.safe_load(text), default=str)


@F.pandas_udf(StringType())
def yaml_json(text: pd.Series) -> pd.Series:
    """YAML as JSON; Spark has no YAML reader."""
    return text.map(yaml_to_json)


def whole_files(spark: SparkSession, pattern: str) -> DataFrame:
    """directory, name, value: files read whole."""
    files = spark.read.format("text").option("wholetext", True).load(pattern)
    path = F.col("_metadata.file_path")
    part = lambda i: F.url_decode(F.replace(F.element_at(F.split(path, "/"), i), F.lit("+"), F.lit("%2B")))
    return files.select(part(-2).alias("directory"), part(-1).alias("name"), "value")


def task_files(spark: SparkSession, root: str, pattern: str = TASKS) -> DataFrame:
    """directory, diff, context, gold (JSON): a row for each task folder; a folder that lacks one of the
    three files is an error."""
    files = whole_files(spark, f"{root}/{pattern}/*").where(F.col("name").isin(FILES))
    rows = files.groupBy("directory").pivot("name", FILES).agg(F.first("value"))
    need = lambda n: F.coalesce(F.col(f"`{n}`"), F.raise_error(F.concat("directory", F.lit(f" lacks {n}"))))
    return rows.select("directory", need(FILES[0]).alias("diff"), need(FILES[1]).alias("context"), yaml_json(need(FILES[2])).alias("gold"))


def load_tasks(spark: SparkSession, root: str, pattern: str = TASKS, lenient: bool = False) -> DataFrame:
    """task_id, diff, context, gold (struct), file_list, prompt, in order of directory. The first gold
    that breaks the contract fails the load; with lenient, rows keep violations and valid instead."""
    checked = validate_gold(task_files(spark, root, pattern))
    rows = checked if lenient else strict(checked).where("valid").drop("violations", "valid")
    prompt = review_prompt(F.col("context"), F.col("gold.prompt_notes"), F.col("diff"))
    return rows.withColumnRenamed("directory", "task_id").withColumn("file_list", diff_files(F.col("diff"))).withColumn("prompt", prompt).orderBy("task_id")


def task_meta(spark: SparkSession, root: str, pattern: str = TASKS) -> DataFrame:
    """directory, mode, parent, parent_defect, status, reason, generator, generator_version, family.
    Spark's readers skip names that begin with an underscore, so the driver reads these small files
    through the same file systems, one for each task."""
    schema = "mode string, parent string, parent_defect string, status string, reason string, generator string, generator_version string, family string"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}/_meta.yaml")
    fs = where.getFileSystem(conf)
    rows = []
    for status in fs.globStatus(where) or []:
        stream = fs.open(status.getPath())
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        rows.append((status.getPath().getParent().getName(), yaml_to_json(text)))
    files = spark.createDataFrame(rows, "directory string, value string")
    return files.select("directory", F.from_json("value", schema).alias("m")).select("directory", "m.*")


def templates(spark: SparkSession, pattern: str) -> DataFrame:
    return whole_files(spark, pattern).select(F.from_json(yaml_json("value"), TEMPLATE).alias("t")).select("t.*")


def prompt_text(spark: SparkSession, folder: str, name: str) -> Column:
    """A prompt file as a literal; one short file."""
    row = whole_files(spark, f"{folder}/{name}.md").first()
    return F.lit(row["value"])
