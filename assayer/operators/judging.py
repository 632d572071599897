"""The judge stage: pluggable, with one corrective retry, and replay from a table as the default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import fold_kind, strip

ATTEMPTS = 2
#: What stands for an answer that stayed unusable: it is scored like any other.
NO_CLAIMS, NO_VERDICTS = '{"claims": []}', '{"verdicts": []}'
CLAIMS = "claims array<struct<id:string,file:string,quote:string,summary:string>>"
VERDICTS = "verdicts array<struct<claim_id:string,kind:string,defect_id:string,second_defect_id:string,status:string,distractor_file:string,unsure:boolean>>"
CORRECTION = "\n\nYour last answer was refused: {reason}. Answer again and keep to the contract."


def judged(inputs: DataFrame, ask: Callable[[str], str], check: Callable[[str], str | None], key: str = "trace_id", prompt: str = "prompt", empty: str = NO_CLAIMS) -> DataFrame:
    """key, answer, attempts, degraded. ask is called with the prompt, and if check finds a fault once
    more with a correction; after that the answer is the empty result and degraded says so.

    Only key and prompt reach the workers, so a judge can't see what it must not. Tasks may run again
    when an executor is lost: write the result before anything reads it twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[prompt]):
                said, fault = None, None
                for attempt in range(1, ATTEMPTS + 1):
                    said = ask(text if fault is None else text + CORRECTION.format(reason=fault))
                    fault = check(said)
                    if fault is None:
                        break
                rows.append((k, said if fault is None else empty, attempt, fault is not None))
            yield pd.DataFrame(rows, columns=[key, "answer", "attempts", "degraded"])

    schema = StructType([inputs.schema[key]]).add("answer", "string").add("attempts", "integer").add("degraded", "boolean")
    return inputs.select(key, prompt).mapInPandas(run, schema)


def replayed(inputs: DataFrame, answers: DataFrame, key: str = "trace_id", empty: str = NO_CLAIMS) -> DataFrame:
    """The same from a table (key, answer) of earlier answers; a missing one is the empty result and
    degraded."""
    found = inputs.select(key).join(answers.select(key, "answer"), key, "left")
    return found.select(key, F.coalesce("answer", F.lit(empty)).alias("answer"), F.lit(0).alias("attempts"), F.col("answer").isNull().alias("degraded"))


def said_claims(answers: DataFrame, key: str = "trace_id") -> DataFrame:
    """key, pos, claim_id, file, quote, summary from extractors' answers; malformed JSON is an error."""
    rows = answers.select(key, F.posexplode(F.from_json("answer", CLAIMS, {"mode": "FAILFAST"})["claims"]).alias("pos", "c"))
    return rows.select(key, "pos", F.col("c.id").alias("claim_id"), "c.file", "c.quote", "c.summary")


def said_verdicts(answers: DataFrame, key: str = "trace_id") -> DataFrame:
    """key, pos and the fields of a verdict from matchers' answers, kinds folded; malformed JSON is an
    error. validate_verdicts() holds them against claims and gold."""
    rows = answers.select(key, F.posexplode(F.from_json("answer", VERDICTS, {"mode": "FAILFAST"})["verdicts"]).alias("pos", "v")).select(key, "pos", "v.*")
    return rows.withColumn("kind", fold_kind(F.col("kind"))).withColumn("unsure", F.coalesce("unsure", F.lit(False)))


def judge_inputs(reviews: DataFrame, key: str = "trace_id", review: str = "review") -> tuple[DataFrame, DataFrame]:
    """(reviews to judge, empty reviews): the empty ones are scored without asking."""
    empty = F.coalesce(strip(F.col(review)), F.lit("")) == ""
    return reviews.where(~empty), reviews.where(empty)


def gold_view(golds: DataFrame) -> DataFrame:
    """task_id and the part of the gold that the matcher may see: defects without their rationale."""
    view = F.to_json(F.struct(F.transform("gold.defects", lambda d: d.dropFields("rationale")).alias("defects"), F.col("gold.distractors").alias("distractors")), {"ignoreNullFields": "false"})
    return golds.select(F.col("gold.id").alias("task_id"), view.alias("gold_view"))


class Registry:
    """Scoring functions (DataFrame to DataFrame) by name."""

    def __init__(self) -> None:
        self.named: dict[str, Callable[..., DataFrame]] = {}

    def reward(self, name: str) -> Callable:
        def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.named[name] = function
            return function

        return add

    def total(self, traces: DataFrame, key: str = "trace_id", **tables: DataFrame) -> DataFrame:
        """key and reward: the sum of all registered rewards (each gives key and value)."""
        out = traces.select(key).withColumn("reward", F.lit(0.0))
        for name, function in sorted(self.named.items()):
            one = function(traces, **tables).select(key, F.col("value").alias(f"_{name}"))
            out = out.join(one, key, "left").withColumn("reward", F.col("reward") + F.coalesce(f"_{name}", F.lit(0.0))).drop(f"_{name}")
        return out
