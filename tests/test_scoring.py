import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import scoring

VERDICTS = "trace_id string, pos int, kind string, defect_id string, second_defect_id string, status string, unsure boolean"


def matched(d, status="full", second=None, unsure=False):
    return ("matched", d, second, status, unsure)


ALARM, DISTRACTOR = ("false_alarm", None, None, "full", False), ("distractor", None, None, "full", False)
CASES = {
    "all full": (2, [matched("d1"), matched("d2")], dict(recall=1, precision=1, f1=1)),
    "two partials": (2, [matched("d1", "partial"), matched("d2", "partial")], dict(recall=0.5, precision=1)),
    "one alarm": (1, [matched("d1"), ALARM], dict(recall=1, precision=0.5, f1=2 / 3, false_alarms=1)),
    "one distractor": (1, [matched("d1"), DISTRACTOR], dict(recall=1, precision=0.5, f1=2 / 3, distractor_hits=1)),
    "no claims": (2, [], dict(recall=0, precision=1, f1=0, claim_count=0)),
    "only distractors": (1, [DISTRACTOR], dict(recall=0, precision=0, f1=0)),
    "duplicate": (1, [matched("d1"), matched("d1"), ALARM], dict(precision=0.5, duplicate=1)),
    "partials of one": (1, [matched("d1", "partial"), matched("d1", "partial")], dict(duplicate=0, recall=0.5)),
    "one credits two": (2, [matched("d1", second="d2")], dict(recall=1)),
    "partial after full": (1, [matched("d1"), matched("d1", "partial")], dict(duplicate=1, recall=1)),
    "full after partial": (1, [matched("d1", "partial"), matched("d1")], dict(duplicate=0, recall=1)),
    "unsure": (1, [matched("d1", unsure=True)], dict(review_required=1)),
    "credit of nothing": (1, [matched(None)], dict(duplicate=1, recall=0, precision=1)),
}


def scored(spark, cases):
    traces = spark.createDataFrame([(k, k) for k in cases], "trace_id string, task_id string")
    defects = spark.createDataFrame([(k, f"d{i}", ("concurrency", "operability")[i % 2]) for k, (n, _, _) in cases.items() for i in range(1, n + 1)], "task_id string, defect_id string, category string")
    rows = [(k, i, *v) for k, (_, vs, _) in cases.items() for i, v in enumerate(vs)]
    verdicts = spark.createDataFrame(rows, VERDICTS)
    claims = verdicts.select("trace_id", F.col("pos").alias("claim_id"))
    return scoring.score_reviews(traces, defects, claims, verdicts)


def test_examples(spark):
    got = {r["trace_id"]: r.asDict() for r in scored(spark, CASES).collect()}
    for name, (_, _, want) in CASES.items():
        for key, value in want.items():
            assert got[name][key] == pytest.approx(value), (name, key)
    assert got["no claims"]["per_category"] == {}


def test_no_verdicts_for_claims(spark):
    """A matcher that gave nothing: categories are there, with 0."""
    traces = spark.createDataFrame([("a", "t")], "trace_id string, task_id string")
    defects = spark.createDataFrame([("t", "d1", "data")], "task_id string, defect_id string, category string")
    claims = spark.createDataFrame([("a", "c1")], "trace_id string, claim_id string")
    r = scoring.score_reviews(traces, defects, claims, spark.createDataFrame([], VERDICTS)).first()
    assert (r["recall"], r["precision"], r["f1"], r["per_category"]) == (0, 0, 0, {"data": 0.0})


def sequential(verdicts):
    full, partial, count, dup = set(), set(), 0, 0
    for kind, a, b, status, _ in verdicts:
        if kind != "matched":
            continue
        credit = [x for x in (a, b) if x]
        if all(x in full for x in credit):
            dup += 1
        else:
            count += 1
            (full if status == "full" else partial).update(credit)
    return dup, len(full) + 0.5 * len(partial - full)


def test_duplicate_rule_against_a_loop(spark):
    rng, cases = random.Random(5), {}
    for i in range(200):
        vs = [rng.choice([ALARM, DISTRACTOR, matched(f"d{rng.randint(1, 3)}", rng.choice(["full", "partial"]), rng.choice([None, "d1", "d2"]))]) for _ in range(rng.randint(1, 8))]
        vs = [v if v[1] != v[2] or v[1] is None else (v[0], v[1], None, *v[3:]) for v in vs]
        cases[f"r{i}"] = (3, vs, {})
    got = {r["trace_id"]: r for r in scored(spark, cases).collect()}
    for name, (n, vs, _) in cases.items():
        dup, credit = sequential(vs)
        assert (got[name]["duplicate"], got[name]["recall"]) == (dup, pytest.approx(credit / n))


def test_metrics_map(spark):
    m = {r["trace_id"]: r["metrics"] for r in scoring.metrics(scored(spark, CASES)).collect()}
    assert m["all full"]["scoring_formula"] == 2.0 and m["all full"]["recall_operability"] == 1.0
    assert "recall_operability" not in m["no claims"]
