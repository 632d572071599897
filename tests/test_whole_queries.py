import os

import duckdb
import pytest

from assayer.operators import inference
from assayer.plans import bridge, made, oracle

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@there
def test_all_keys_are_validated(spark):
    assert "% 5 = 0" not in oracle.SQL["contract_violations"]
    want = duckdb.connect().execute(f"SELECT count(DISTINCT o_orderkey) FROM '{SF}/orders.parquet'").fetchone()[0]
    assert bridge.contract_violations(spark, SF).count() == want


def test_passages_within_words_and_short_ones(spark, tmp_path):
    texts = ["he said: “alpha beta gamma delta epsilon zeta eta” twice", "(one two three four) and more", "tiny!", "nothing here", None, "xalpha `beta`  gamma\ndelta epsilon zeta etas"]
    quotes = ["alpha beta gamma delta epsilon zeta eta", "one two three four", "tiny", "beta gamma", "a b c d e f g", "pha beta gamma delta epsilon ze"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = lambda t: " ".join(t.replace("`", "").split())
    want = {(d, i) for d, t in enumerate(texts) if t for i, q in enumerate(quotes) if plain(q) in plain(t)}
    got = [tuple(r) for r in bridge.verbatim_containment(spark, str(tmp_path)).select("doc_id", "item_id").collect()]
    assert len(want) == 8 and set(got) == want and len(got) == len(want)


def test_seeded_bootstrap_has_the_operators_draws(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(inference, "seeded_draws", lambda *a, **k: seen.setdefault("draws", a[3]) and None)
    monkeypatch.setattr(inference, "gaps", lambda cell, *a: cell)
    monkeypatch.setattr(inference, "interval", lambda gap, *a: gap)
    try:
        bridge.bootstrap_seeded(spark, SF)
    except Exception:  # only the draws asked for are looked at
        pass
    assert seen["draws"] == inference.DRAWS == 10_000


test_seeded_bootstrap_has_the_operators_draws = there(test_seeded_bootstrap_has_the_operators_draws)


@there
@pytest.mark.parametrize("name", ["diff_parse", "diff_emit", "line_places", "line_span_ownership", "gold_anchor", "hunk_headers"])
def test_tasks_dont_grow_with_the_lines(spark, monkeypatch, name):
    monkeypatch.setattr(bridge, "ROWS", 500, raising=False)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    found = (bridge.queries() | made.queries())[name](spark, SF)
    assert found.rdd.getNumPartitions() == -(-lines // 500) > 10


@there
def test_tasks_are_checked_once(spark, monkeypatch):
    monkeypatch.setattr(made, "GOLDS", 1, raising=False)
    tasks = made.made_tasks(spark, SF)
    assert tasks.where("task_id <> 't1'").count() == tasks.count() - 1
    assert "from_json" not in tasks.where("task_id <> 't1'")._jdf.queryExecution().optimizedPlan().toString()
