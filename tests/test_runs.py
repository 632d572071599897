import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import inference, runs
from assayer.sources.runs import rollouts


def rescored(metrics, f1):
    if metrics.get("scoring_formula", 1.0) >= 2.0 or any(k not in metrics for k in runs.NEEDED) or metrics["claim_count"] == 0:
        return f1, metrics.get("precision", 0.0)
    c, x, d, r, p = (metrics[k] for k in runs.NEEDED)
    c, x, d, r, p = metrics["claim_count"], metrics["distractor_hits"], metrics["duplicate"], metrics["recall"], metrics["precision"]
    left = c - x - d
    hits = round(p * left) if left > 0 else 0
    q = 1.0 if c - d <= 0 else hits / (c - d)
    return (0.0 if q + r == 0 else 2 * q * r / (q + r)), q


CASES = [
    {"scoring_formula": 2.0, "claim_count": 3.0, "distractor_hits": 1.0, "duplicate": 0.0, "recall": 1.0, "precision": 1.0},
    {"claim_count": 3.0, "distractor_hits": 1.0, "duplicate": 0.0, "recall": 1.0, "precision": 1.0},
    {"claim_count": 3.0, "distractor_hits": 1.0, "duplicate": 0.0, "recall": 1.0},
    {"claim_count": 0.0, "distractor_hits": 0.0, "duplicate": 0.0, "recall": 0.0, "precision": 1.0},
    {"claim_count": 2.0, "distractor_hits": 2.0, "duplicate": 0.0, "recall": 0.0, "precision": 1.0},
    {"claim_count": 5.0, "distractor_hits": 0.0, "duplicate": 0.0, "recall": 0.5, "precision": 0.5},
    {"claim_count": 2.0, "distractor_hits": 0.0, "duplicate": 2.0, "recall": 0.5, "precision": 0.0},
    {},
]


def test_rescore(spark):
    df = spark.createDataFrame([(i, m, 0.25) for i, m in enumerate(CASES)], "i int, metrics map<string,double>, f1 double")
    for r in runs.rescore(df).collect():
        f1, precision = rescored(CASES[r["i"]], 0.25)
        assert (r["f1"], r["metrics"]["precision"]) == (pytest.approx(f1), pytest.approx(precision)), CASES[r["i"]]


@pytest.fixture
def run_dirs(tmp_path):
    def line(task, model, f1, rewards=True):
        agent = None if model is None else {"model": model}
        return json.dumps({"task": {"data": {"task_id": task}}, "traces": [{"rewards": {"f1": {"score": f1}} if rewards else None, "agent": agent, "metrics": {"scoring_formula": 2.0, "precision": f1, "recall": f1}}]})

    a, b = tmp_path / "env--prov--beta--h--1", tmp_path / "plain"
    a.mkdir(), b.mkdir()
    a.joinpath("traces.jsonl").write_text("\n".join([line("t001", None, 0.5), "", line("t001-d1", "", 1.0), "   ", line("t002", "x", 0.0, False)]) + "\n")
    b.joinpath("traces.jsonl").write_text("\n".join([line("t001", "alpha", 0.25), line("t002", None, 0.75)]))
    return [str(a), str(b)]


def test_runs_of_one_name_and_lines_of_split_files(spark, tmp_path):
    many = [json.dumps({"task": {"data": {"task_id": "t001"}}, "traces": [{"rewards": {"f1": {"score": 1.0}}, "agent": {"model": f"m{i:03d}"}}]}) for i in range(60)]
    paths = []
    for i, part in enumerate((many[:50][::-1], many[50:])):
        folder = tmp_path / f"up+{i} x" / "run+1"
        folder.mkdir(parents=True)
        folder.joinpath("traces.jsonl").write_text("\r\n".join(part))
        paths.append(str(folder))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        rows = rollouts(spark, paths)
        assert rows.rdd.getNumPartitions() > 4 and {r["run"] for r in rows.collect()} == {"run+1"}
        got = [r["model"] for r in runs.model_order(rows).orderBy("place").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"m{i:03d}" for i in [*range(50)[::-1], *range(50, 60)]]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "traces.jsonl").write_text("{")
    with pytest.raises(Exception, match="MALFORMED"):
        rollouts(spark, [str(tmp_path / "bad")]).collect()


def test_reader_and_reports(spark, run_dirs):
    rows = rollouts(spark, run_dirs)
    assert sorted((r["model"], r["task_id"], r["f1"]) for r in rows.collect()) == [("alpha", "t001", 0.25), ("beta", "t001", 0.5), ("beta", "t001-d1", 1.0), ("plain", "t002", 0.75)]
    models = [r["model"] for r in runs.model_order(rows).orderBy("place").collect()]
    assert models == ["beta", "alpha", "plain"]
    assert runs.markdown_table(rows, "curated", models).splitlines()[2:] == ["| t001 | 0.50 | 0.25 | — |", "| t002 | — | — | 0.75 |", "| **Mean** | **0.50** | **0.25** | **0.75** |"]
    assert "| t001-d1 | 1.00 | 1.00 | 1.00 | 0.0 | 0.0 | 0.0 |" in runs.markdown_detail(rows, "sub-tasks", "beta")


def test_malformed_line_is_an_error(spark, tmp_path):
    d = tmp_path / "r"
    d.mkdir()
    d.joinpath("traces.jsonl").write_text('{"task": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        rollouts(spark, [str(d)]).collect()


def test_bootstrap_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(f"t00{s}" + ("-d1" if s > 4 else ""), m, rng.random()) for s in range(1, 8) for m in ("a", "b", "c") for _ in range(rng.randint(0, 3))]
    rows.append(("t009", "c", 0.5))  # a scenario that only a third model saw
    got = {r["population"]: r for r in inference.bootstrap(spark, spark.createDataFrame(rows, "task_id string, model string, f1 double"), "a", "b", draws=300).collect()}
    stream = random.Random(inference.SEED)
    for which, own in (("curated", [r for r in rows if "-d" not in r[0]]), ("sub-tasks", [r for r in rows if "-d" in r[0]])):
        names = sorted({r[0].split("-d")[0] for r in own})
        cell = lambda s, m: [r[2] for r in own if r[0].split("-d")[0] == s and r[1] == m]  # noqa: B023, E731

        def gap(draw):
            x, y = [f for s in draw for f in cell(s, "a")], [f for s in draw for f in cell(s, "b")]  # noqa: B023
            return sum(x) / len(x) - sum(y) / len(y) if x and y else None

        gaps = sorted(g for g in (gap([stream.choice(names) for _ in names]) for _ in range(300)) if g is not None)
        r = got[which]
        assert r["gap"] == pytest.approx(gap(names)) and r["scenarios"] == len(names)
        assert (r["lo"], r["hi"]) == (pytest.approx(gaps[int(0.025 * len(gaps))]), pytest.approx(gaps[int(0.975 * len(gaps))]))
        assert r["separated"] == (r["lo"] > 0 or r["hi"] < 0)


def test_unpaired_population_has_no_row(spark):
    rows = spark.createDataFrame([("t001", "a", 1.0), ("t001-d1", "a", 1.0), ("t001-d1", "b", 1.0)], "task_id string, model string, f1 double")
    got = inference.bootstrap(spark, rows, "a", "b", draws=10).collect()
    assert [(r["population"], r["lo"], r["separated"]) for r in got] == [("sub-tasks", 0.0, False)]
    assert inference.bootstrap(spark, rows.where(F.lit(False)), "a", "b", draws=10, seed=None).count() == 0
