"""Content keys, costs and the running budget."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

TARGET, HARD_STOP = 10.0, 12.0
SHORT = 16


def canonical_json(value) -> str:
    """Sorted keys, no white space, ASCII; the form that content hashes are taken of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


@F.pandas_udf(StringType())
def _canonical(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else canonical_json(json.loads(t)))


def content_hash(value_json: Column) -> Column:
    """SHA-256 of the canonical form of any JSON text. JSON of unknown shape can't be put in order by
    built-in functions; known shapes are written in order, see json_text."""
    return F.sha2(_canonical(value_json), 256)


def json_text(text: Column) -> Column:
    """A text as a JSON string in ASCII, in built-in functions. Null stays null."""
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        out = F.when(n > 0xFFFF, F.concat(four(F.shiftright(n - 0x10000, 10) + 0xD800), four(((n - 0x10000) % 1024) + 0xDC00))).when((n < 32) | (n > 126), four(n)).otherwise(c)
        for plain, said in {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}.items():
            out = F.when(c == F.lit(plain), F.lit(said)).otherwise(out)
        return out

    # only texts with such characters are taken apart
    escaped = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r'[^ !#-\[\]-~]'), escaped).otherwise(text), F.lit('"'))


def json_object(parts: dict[str, Column]) -> Column:
    """The canonical form of an object of texts; null if one of them is."""
    said = [x for i, (k, v) in enumerate(sorted(parts.items())) for x in (F.lit(("," if i else "{") + json.dumps(k) + ":"), json_text(v))]
    return F.concat(*said, F.lit("}"))


def gold_version(gold_json: Column) -> Column:
    """Content hash of a gold record; a missing prompt_notes is the empty text."""

    @F.pandas_udf(StringType())
    def full(text: pd.Series) -> pd.Series:
        fields = ("id", "difficulty", "source", "defects", "distractors")

        def one(t):
            if t is None:
                return None
            gold = json.loads(t)
            return canonical_json({k: gold.get(k) for k in fields} | {"prompt_notes": gold.get("prompt_notes") or ""})

        return text.map(one)

    return F.sha2(full(gold_json), 256)


def review_hash(review: Column) -> Column:
    """Null reviews have none."""
    return F.substring(F.sha2(json_object({"review": review}), 256), 1, SHORT)


def verdict_key(task: Column, review: Column, gold: Column, prompt: Column, model: Column) -> Column:
    """Null if a part is null."""
    return F.substring(F.sha2(json_object({"task_id": task, "review": review_hash(review), "gold": gold, "prompt": prompt, "model": model}), 256), 1, SHORT)


def native_key(*parts: Column) -> Column:
    """A key of the same length from built-in functions only; not byte-equal to verdict_key."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, SHORT)


def cost(input_tokens: Column, output_tokens: Column, per_input: Column, per_output: Column) -> Column:
    """US dollars; prices are for a million tokens."""
    return input_tokens / 1e6 * per_input + output_tokens / 1e6 * per_output


def priced(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """usage with cost. Unknown models and negative prices are errors."""
    price = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("no valid price for model "), "model")))
    joined = usage.join(rates, "model", "left")
    return joined.withColumn("cost", cost(F.col("input_tokens"), F.col("output_tokens"), price("input_per_1m"), price("output_per_1m"))).drop("input_per_1m", "output_per_1m")


def running_budget(costs: DataFrame, by: list[str], order: list[str], target: float = TARGET, hard_stop: float = HARD_STOP) -> DataFrame:
    """costs with spent so far (this call included), remaining of the target, and whether the hard stop
    is reached; the call that reaches it counts. Spending runs within `by`, so ledgers are spread."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = costs.withColumn("spent", F.sum("cost").over(so_far))
    return spent.withColumn("remaining", F.greatest(F.lit(0.0), F.lit(target) - F.col("spent"))).withColumn("exceeded", F.col("spent") >= hard_stop)


def stopped_at(budget: DataFrame, by: list[str], order: str) -> DataFrame:
    """For each ledger the first call that reached the hard stop."""
    return budget.where("exceeded").groupBy(*by).agg(F.min(order).alias("stopped_at"))
