import hashlib
import json

import pytest
from pyspark.sql import functions as F

from assayer.config import Config, JudgeConfig
from assayer.functions import text as T
from assayer.operators import judging, ledger


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_text(spark):
    c = F.col("a")
    assert one(spark, T.strip(c), a="  x y\t\n") == "x y"
    assert one(spark, T.verbatim(c), a=" `a` \n b ") == "a b"
    assert one(spark, T.fold_kind(c), a=" Matched") == " matched"
    assert one(spark, T.model_of(c), a="e--p--m--h--1") == "m" and one(spark, T.model_of(c), a="e--p") == "e--p"
    assert one(spark, T.parent_task(c), a="t001-x-d12") == "t001-x"
    assert one(spark, T.population(c), a="t001-d1") == "sub-tasks" and one(spark, T.population(c), a="t001-dx") == "curated"
    assert one(spark, T.stem(c), a="/x/matcher.v2.md") == "matcher.v2"
    assert one(spark, T.estimated_tokens(c), a="") == 1 and one(spark, T.estimated_tokens(c), a="é" * 9) == 2
    assert one(spark, T.strip_fences(c), a='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.diff_files(c), a="--- a/x y\n+++ b/x y\n--- /dev/null\n+++ b/a b\n") == ["a b", "x y"]
    assert one(spark, T.delimiter_balance(c), a="f(x[1]{") == 2
    tool = lambda kind, schema: json.dumps({"type": kind, "function": {"input_schema": schema}})
    assert one(spark, T.schema_snippet(c), a=f'{{"tools":[{tool("x", {"n": 1})},"y",{tool("function", "s")},{tool("function", {"t": 1})}]}}') == '{"t":1}'
    assert one(spark, T.schema_snippet(c), a=f'{{"response_format":{{"json_schema":{{"schema":{{"r":1}}}}}},"tools":[{tool("function", {"t": 1})}]}}') == '{"r":1}'
    assert one(spark, T.schema_snippet(c), a='{"response_format":"json","tools":[{"input_schema":{"t":1}}]}') is None
    assert one(spark, T.request_model(c, "Judge-1", "j", "r"), a="x/JUDGE-1-b") == "j" and one(spark, T.request_model(c, "Judge-1", "j", "r"), a=None) == "r"
    assert one(spark, T.pruned_context(c, F.lit("b.py"), F.array(F.lit("a.py"))), a="a.py\n\na.py b.py\n\nx") == "a.py b.py\n\nx"
    assert one(spark, T.looks_like_binding(c), a="  x = 1") and not one(spark, T.looks_like_binding(c), a="f(x)")
    assert "(no description provided)" in one(spark, T.review_prompt(c, F.lit(""), c), a="z")
    assert one(spark, T.model_family(c, ["gpt"]), a="GPT-4")


def test_content_keys(spark):
    value = {"b": [1, None, "é"], "a": "\x1f"}
    want = hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, ledger.content_hash(F.col("a")), a=json.dumps(value)) == want
    gold = {"id": "t", "difficulty": "easy", "source": {}, "defects": [], "distractors": []}
    version = lambda g: one(spark, ledger.gold_version(F.col("a")), a=json.dumps(g))
    assert version(gold) == version(gold | {"prompt_notes": ""}) != version(gold | {"prompt_notes": "x"})


def test_json_text(spark):
    texts = ["", "plain", 'q " \\ / \x7f', "é€\U0001F600\uffff", "\n\r\t\b\f\x00\x1f~ !"]
    got = spark.createDataFrame([(t,) for t in texts], "a string").select(ledger.json_text(F.col("a")).alias("x"), ledger.review_hash(F.col("a")).alias("h")).collect()
    assert [r["x"] for r in got] == [json.dumps(t) for t in texts]
    assert [r["h"] for r in got] == [hashlib.sha256(ledger.canonical_json({"review": t}).encode()).hexdigest()[:16] for t in texts]
    assert one(spark, ledger.json_text(F.col("a")), a=None) is None


def test_prompt_of_request(spark):
    block = lambda kind, text: {"type": kind, "text": text}
    schema = {"json_schema": {"schema": {"b": [1, {}], "a": "é"}}}
    bodies = {
        json.dumps({"system": "s", "messages": [{"role": "user", "content": "hi"}, {"content": ""}]}): "s\n\nuser: hi\n\nuser: ",
        json.dumps({"system": [block("text", "a"), block("x", "b"), {"type": "text"}], "messages": [{"role": "r", "content": [block("text", "1"), block("image", "2"), block("text", "3")]}]}): "a\n\n\n\nr: 1\n3",
        json.dumps({"system": "", "messages": [{"role": "r", "content": [block("image", "2")]}, {"role": "q", "content": None}]}): "",
        json.dumps({"system": "[1]", "messages": [{"role": "r", "content": "[2]"}]}): "[1]\n\nr: [2]",
        json.dumps({"response_format": schema}): "Output must be a single JSON object matching this JSON Schema:\n\n" + json.dumps(schema["json_schema"]["schema"], indent=2),
        "{}": "",
    }
    got = spark.createDataFrame([(b,) for b in bodies], "a string").select("a", T.prompt_of_request(F.col("a")).alias("x")).collect()
    assert {r["a"]: r["x"] for r in got} == bodies


def test_verdict_key_depends_on_each_part(spark):
    parts = dict(t="t", r="review", g="g", p="p", m="m")
    key = lambda **kw: one(spark, ledger.verdict_key(*[F.col(c) for c in "trgpm"]), **(parts | kw))
    keys = {key(), *(key(**{k: "other"}) for k in parts)}
    assert len(keys) == 6 and all(len(k) == 16 for k in keys) and key() == key()


def test_budget(spark):
    usage = spark.createDataFrame([(i, "m", 1_000_000, 0) for i in range(1, 6)], "seq int, model string, input_tokens long, output_tokens long").withColumn("run", F.lit("r"))
    rates = spark.createDataFrame([("m", 3.0, 15.0)], "model string, input_per_1m double, output_per_1m double")
    rows = ledger.running_budget(ledger.priced(usage, rates), ["run"], ["seq"]).orderBy("seq").collect()
    assert [r["spent"] for r in rows] == [3, 6, 9, 12, 15] and [r["remaining"] for r in rows] == [7, 4, 1, 0, 0]
    assert [r["exceeded"] for r in rows] == [False, False, False, True, True]
    assert spark.range(1).select(ledger.cost(F.lit(1e6), F.lit(1e6), F.lit(3.0), F.lit(15.0))).first()[0] == 18.0
    with pytest.raises(Exception, match="no valid price"):
        ledger.priced(usage.withColumn("model", F.lit("z")), rates).collect()


def test_judge_retries_once_and_degrades(spark):
    inputs = spark.createDataFrame([("a", "good"), ("b", "mend"), ("c", "never")], "trace_id string, prompt string")

    def ask(prompt):
        return "ok" if prompt.startswith("good") or (prompt.startswith("mend") and "refused" in prompt) else "bad"

    got = {r["trace_id"]: (r["answer"], r["attempts"], r["degraded"]) for r in judging.judged(inputs, ask, lambda a: None if a == "ok" else "not ok").collect()}
    assert got == {"a": ("ok", 1, False), "b": ("ok", 2, False), "c": (judging.NO_CLAIMS, 2, True)}
    answers = spark.createDataFrame([("a", "x")], "trace_id string, answer string")
    assert {r["trace_id"]: r["degraded"] for r in judging.replayed(inputs, answers).collect()} == {"a": False, "b": True, "c": True}
    assert judging.said_claims(judging.replayed(inputs, answers.where("false"))).count() == 0, "the empty result has no claims"
    asked, empty = judging.judge_inputs(spark.createDataFrame([("a", "r"), ("b", "  "), ("c", None), ("d", "\n\t")], "trace_id string, review string"))
    assert (asked.count(), empty.count()) == (1, 3)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        judging.said_verdicts(answers).collect()


def test_rewards_sum(spark):
    registry = judging.Registry()
    registry.reward("one")(lambda t: t.withColumn("value", F.lit(1.0)))
    registry.reward("two")(lambda t: t.where("trace_id = 'a'").withColumn("value", F.lit(2.0)))
    rows = registry.total(spark.createDataFrame([("a",), ("b",)], "trace_id string")).collect()
    assert {r["trace_id"]: r["reward"] for r in rows} == {"a": 3.0, "b": 1.0}


def test_config():
    assert Config().override("judge.model", "m").judge.model == "m"
    with pytest.raises(KeyError):
        Config().override("judge.nothing", 1)
    with pytest.raises(ValueError):
        JudgeConfig(rates={"m": (-1.0, 0.0)})
