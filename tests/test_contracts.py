import copy
import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import contracts


def defect(i, category="data", lines=(1, 2)):
    return {"id": f"d{i}", "category": category, "file": " a.py ", "lines": list(lines) if lines else lines, "summary": "s", "rationale": "r"}


def distractor(i, lines=None):
    return {"id": f"x{i}", "file": "a.py", "lines": lines, "concern": "c", "why_ok": "w"}


GOOD = {"id": "t1", "difficulty": "medium", "source": {"kind": "synthetic"}, "defects": [defect(1), defect(2, "security")], "distractors": [distractor(1, [3, 9])], "prompt_notes": "n"}


def changed(**new):
    return copy.deepcopy(GOOD) | new


def without(key):
    return {k: v for k, v in GOOD.items() if k != key}


OSS = {"kind": "oss", "url": "u", "license": "MIT", "attribution": "a"}
GOLDS = [
    (GOOD, None),
    (without("prompt_notes"), None),
    (without("source"), "misses keys"),
    (changed(id="t2"), "directory"),
    (changed(difficulty="odd"), "difficulty"),
    (changed(source={"url": "x"}), "kind"),
    (changed(source={"kind": "web"}), "source kind"),
    (changed(source={"kind": "synthetic", "url": "x"}), "extra fields"),
    (changed(source=OSS), None),
    (changed(source={k: v for k, v in OSS.items() if k != "url"}), "misses a field"),
    (changed(source=OSS | {"license": "GPL-3.0"}), "permissive"),
    (changed(source=OSS | {"more": "x"}), "unknown fields"),
    (changed(defects=[]), "1 to 4"),
    (changed(defects=[{k: v for k, v in defect(1).items() if k != "summary"}, defect(2, "security")]), "misses a key"),
    (changed(defects=[defect(1) | {"z": 1}, defect(2, "security")]), "unknown keys"),
    (changed(defects=[defect(1, "style"), defect(2, "security")]), "unknown category"),
    (changed(defects=[defect(1, lines=(1,)), defect(2, "security")]), "two numbers"),
    (changed(defects=[defect(1, lines=(True, 2)), defect(2, "security")]), "two numbers"),
    (changed(defects=[defect(1, lines=(0, 2)), defect(2, "security")]), "two numbers"),
    (changed(defects=[defect(1, lines=(3, 2)), defect(2, "security")]), "two numbers"),
    (changed(distractors=[distractor(1, [5])]), "distractor lines"),
    (changed(distractors=[{k: v for k, v in distractor(1).items() if k != "lines"}]), "distractor misses"),
    (changed(distractors=[distractor(1) | {"z": 1}]), "distractor has unknown"),
    (changed(defects=[defect(1)]), "number of defects"),
    (changed(distractors=[]), "number of distractors"),
    (changed(defects=[defect(1), defect(2)]), "distinct"),
    (changed(defects=[defect(1), defect(3, "security")]), "d1, d2"),
    (changed(distractors=[distractor(2)]), "x1, x2"),
    (changed(extra=1), "unknown keys"),
]


def test_gold(spark):
    rows = [(i, "t1", json.dumps(g)) for i, (g, _) in enumerate(GOLDS)]
    checked = contracts.validate_gold(spark.createDataFrame(rows, "i int, directory string, gold string"))
    for r in checked.collect():
        want = GOLDS[r["i"]][1]
        if want is None:
            assert r["valid"] and r["violations"] == [], (r["i"], r["violations"])
            assert r["gold"]["defects"][0]["file"] == "a.py"
        else:
            assert not r["valid"] and want in r["violations"][0], (r["i"], want, r["violations"])
    good, bad = contracts.quarantine(checked)
    assert good.count() + bad.count() == len(GOLDS) and bad.count() == sum(w is not None for _, w in GOLDS)
    with pytest.raises(Exception, match="misses keys"):
        contracts.strict(checked.where("i = 2")).collect()


def test_quarantine_reads_golds_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def said(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([(i, d, json.dumps(g)) for i, (d, g) in enumerate([("t1", GOOD), ("t2", GOOD)])], "i int, directory string, text string")
    good, bad = contracts.quarantine(contracts.validate_gold(rows.withColumn("gold", F.udf(said)("text")).drop("text")))
    assert [r["i"] for r in good.collect()] == [0] and [r["i"] for r in bad.collect()] == [1]
    assert seen.value == 2


CLAIMS = [
    ([("c1", "a.py", "uses `x`  twice", "s"), ("c2", "general", "bad", "s")], None),
    ([("c2", "a.py", "bad", "s")], "c1, c2"),
    ([("c1", "b.py", "bad", "s")], "isn't in the diff"),
    ([("c1", "a.py", " ", "s")], "empty quote"),
    ([("c1", "a.py", "worse", "s")], "verbatim"),
    ([("c1", "a.py", "bad", " ")], "empty summary"),
    ([("c1", "a.py", "``", "s")], None),
    ([], None),
]


def test_claims(spark):
    rows = [(i, ["a.py"], c, "it uses x\n twice, `bad`") for i, (c, _) in enumerate(CLAIMS)]
    schema = "i int, file_list array<string>, claims array<struct<id:string,file:string,quote:string,summary:string>>, review string"
    for r in contracts.validate_claims(spark.createDataFrame(rows, schema)).collect():
        want = CLAIMS[r["i"]][1]
        assert (r["valid"], True) == (want is None, want is None or want in r["violations"][0]), (r["i"], r["violations"])


VERDICTS = [
    ([("c1", "matched", "d1", None, None), ("c2", "distractor", None, None, "a.py")], None),
    ([("c1", "matched", "d1", None, None), ("c9", "false_alarm", None, None, None)], "unknown claim"),
    ([("c1", "matched", "d1", None, None), ("c1", "false_alarm", None, None, None)], "more than one"),
    ([("c1", "matched", None, None, None), ("c2", "false_alarm", None, None, None)], "no defect"),
    ([("c1", "matched", "d9", None, None), ("c2", "false_alarm", None, None, None)], "unknown defect"),
    ([("c1", "matched", "d1", "d9", None), ("c2", "false_alarm", None, None, None)], "unknown defect"),
    ([("c1", "matched", "d1", "d1", None), ("c2", "false_alarm", None, None, None)], "twice"),
    ([("c1", "distractor", None, None, "b.py"), ("c2", "false_alarm", None, None, None)], "unknown file"),
    ([("c1", " matched", "d1", None, None), ("c2", "false_alarm", None, None, None)], "invalid kind"),
    ([("c1", "matched", "d1", None, None)], "no verdict"),
]


def test_verdicts(spark):
    n = len(VERDICTS)
    traces = spark.createDataFrame([(i, "t") for i in range(n)], "trace_id int, task_id string")
    claims = spark.createDataFrame([(i, c) for i in range(n) for c in ("c1", "c2")], "trace_id int, claim_id string")
    rows = [(i, p, *v) for i, (vs, _) in enumerate(VERDICTS) for p, v in enumerate(vs)]
    verdicts = spark.createDataFrame(rows, "trace_id int, pos int, claim_id string, kind string, defect_id string, second_defect_id string, distractor_file string")
    defects = spark.createDataFrame([("t", "d1"), ("t", "d2")], "task_id string, defect_id string")
    files = spark.createDataFrame([("t", "a.py")], "task_id string, file string")
    for r in contracts.validate_verdicts(traces, claims, verdicts, defects, files).collect():
        want = VERDICTS[r["trace_id"]][1]
        assert (r["valid"], True) == (want is None, want is None or want in r["violations"][0]), (r["trace_id"], r["violations"])


def test_rates(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0), ("b", -1.0, 0.0), ("c", None, 0.0)], "model string, input_per_1m double, output_per_1m double")
    assert {r["model"]: r["valid"] for r in contracts.validate_rates(rows).collect()} == {"a": True, "b": False, "c": False}
