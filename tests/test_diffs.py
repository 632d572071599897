import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import contracts, diffs, names, subtasks
from assayer.sources import sinks, tasks

DIFF = """diff --git a/pkg/a.py b/pkg/a.py
index 1..2 100644
--- a/pkg/a.py
+++ b/pkg/a.py
@@ -1,5 +1,6 @@
-import os
+import os, sys
 one
-two
+TWO
+two and a half
 three

 four
@@ -20,3 +21,2 @@
 x
-gone
 y
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1 @@
+sys.exit(0)
"""


def parsed(spark, diff=DIFF, **kw):
    return diffs.parse(spark.createDataFrame([("t", diff)], "task_id string, diff string"), **kw)


def test_parse_and_number(spark):
    rows = [(r["path"], r["hunk_no"], r["prefix"], r["text"], r["old_no"], r["new_no"]) for r in parsed(spark).orderBy("path", "hunk_no", "pos").collect()]
    assert rows[0] == ("new.py", 1, "+", "sys.exit(0)", None, 1)
    assert rows[1:4] == [("pkg/a.py", 1, "-", "import os", 1, None), ("pkg/a.py", 1, "+", "import os, sys", None, 1), ("pkg/a.py", 1, " ", "one", 2, 2)]
    assert rows[-2:] == [("pkg/a.py", 2, "-", "gone", 21, None), ("pkg/a.py", 2, " ", "y", 22, 22)]
    assert parsed(spark, blank_is_context=True).count() == len(rows) + 1
    with pytest.raises(Exception, match="malformed hunk header"):
        parsed(spark, "diff --git a/x b/x\n@@ bad @@\n+x\n").collect()


def test_emit_round_trip(spark):
    whole = diffs.whole_hunks(parsed(spark), diffs.HUNK).withColumn("place", F.col("hunk_no"))
    text = diffs.emit(whole, ["task_id"]).first()["diff"]
    assert text.startswith("diff --git a/new.py b/new.py\n--- a/new.py\n+++ b/new.py\n@@ -0,0 +1,1 @@\n+sys.exit(0)\n")
    again = parsed(spark, text)
    columns = ["path", "hunk_no", "pos", "prefix", "text", "old_no", "new_no"]
    assert sorted(map(str, again.select(columns).collect())) == sorted(map(str, parsed(spark).select(columns).collect()))


def test_places_and_owners(spark):
    lines = diffs.positioned(parsed(spark))
    place = {(r["hunk_no"], r["text"]): r["place"] for r in lines.where("path = 'pkg/a.py' and prefix <> ' '").collect()}
    assert place == {(1, "import os"): 1, (1, "import os, sys"): 1, (1, "two"): 3, (1, "TWO"): 3, (1, "two and a half"): 4, (2, "gone"): 22}
    spans = spark.createDataFrame([("t", "d1", "pkg/a.py", 3, 3), ("t", "d2", "pkg/a.py", 3, 4)], "task_id string, defect_id string, path string, lo int, hi int")
    owned = diffs.owners(lines, spans)
    assert sorted((r["defect_id"], r["text"]) for r in owned.collect()) == [("d1", "TWO"), ("d1", "two"), ("d2", "TWO"), ("d2", "two"), ("d2", "two and a half")]
    assert diffs.conflicts(owned).count() == 2


def test_anchor_takes_the_first_of_equals(spark):
    rows = parsed(spark)
    got = diffs.anchors(diffs.whole_hunks(rows, diffs.HUNK).withColumn("place", F.col("hunk_no")), ["task_id", "path"]).collect()
    assert {(r["path"], r["lo"], r["hi"]) for r in got} == {("pkg/a.py", 1, 4), ("new.py", 1, 1)}


def gold(**more):
    d = [
        {"id": "d1", "category": "data", "file": "pkg/a.py", "lines": [3, 4], "summary": "s", "rationale": "r"},
        {"id": "d2", "category": "security", "file": "pkg/a.py", "lines": [21, 22], "summary": "s", "rationale": "r"},
        {"id": "d3", "category": "operability", "file": "new.py", "lines": [1, 1], "summary": "s", "rationale": "r"},
    ]
    x = [{"id": "x1", "file": "new.py", "lines": None, "concern": "c", "why_ok": "w"}, {"id": "x2", "file": "pkg/a.py", "lines": [1, 1], "concern": "c", "why_ok": "w"}]
    return {"id": "t001-x", "difficulty": "hard", "source": {"kind": "synthetic"}, "defects": d, "distractors": x, "prompt_notes": ""} | more


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "t001-x"
    folder.mkdir()
    folder.joinpath("diff.patch").write_text(DIFF)
    folder.joinpath("context.md").write_text("All of it.\n\nOnly new.py here.\n\npkg/a.py and new.py.")
    folder.joinpath("gold.yaml").write_text(json.dumps(gold()))
    folder.joinpath("_meta.yaml").write_text('{"mode": "decomposed", "status": "clean"}')
    return str(tmp_path)


def test_load_and_decompose(spark, root, tmp_path):
    loaded = tasks.load_tasks(spark, root)
    row = loaded.first()
    assert row["task_id"] == "t001-x" and row["file_list"] == ["new.py", "pkg/a.py"] and "(no description provided)" in row["prompt"]
    assert tasks.task_meta(spark, root).first()["mode"] == "decomposed"
    made = subtasks.decompose(loaded).persist()
    subs = {r["id"]: r for r in made.collect()}
    one, two, three = (subs[f"t001-x-d{i}"] for i in (1, 2, 3))
    assert one["diff"] == "diff --git a/pkg/a.py b/pkg/a.py\n--- a/pkg/a.py\n+++ b/pkg/a.py\n@@ -2,3 +2,4 @@\n one\n-two\n+TWO\n+two and a half\n three\n" or "four" in one["diff"]
    assert two["diff"].endswith("@@ -20,3 +21,2 @@\n x\n-gone\n y\n")
    assert three["status"] == "clean" and "sys.exit" in three["diff"]
    assert one["gold"]["defects"][0]["lines"] == ["3", "4"] and two["gold"]["defects"][0]["lines"] == ["21", "22"]
    assert [x["id"] for x in one["gold"]["distractors"]] == ["x1"] and one["gold"]["difficulty"] == "easy"
    assert "Only new.py" not in one["context"] and "pkg/a.py and new.py" in one["context"]
    out = tmp_path / "out"
    assert sinks.write_folders(made, str(out)) == sorted(subs)
    assert (out / "t001-x-d1" / "diff.patch").read_text() == one["diff"]
    sinks.write_subtasks(made, str(tmp_path / "table"))
    assert spark.read.parquet(f"{tmp_path}/table/tasks").count() == 3


def test_names_are_closed(spark):
    diff = "diff --git a/a.py b/a.py\n@@ -1,2 +1,3 @@\n-import os\n+from b import helper\n x\n y\n@@ -10,1 +11,2 @@\n z\n+helper(1)\n"
    d = [{"id": f"d{i}", "category": c, "file": "a.py", "lines": lines, "summary": "s", "rationale": "r"} for i, c, lines in ((1, "data", [12, 12]), (2, "security", [3, 3]))]
    checked = contracts.validate_gold(spark.createDataFrame([("t1", json.dumps(gold(id="t1", difficulty="medium", defects=d)))], "directory string, gold string"))
    rows = checked.selectExpr("directory AS task_id", "gold").withColumn("diff", F.lit(diff)).withColumn("context", F.lit("c"))
    both = {r["parent_defect"]: r for r in subtasks.decompose(rows).collect()}
    one = both["d1"]
    # pulled lines go by old number, and an addition has none
    assert "@@ -1,1 +1,1 @@\n+from b import helper\n-import os\n" in one["diff"] and one["status"] == "clean"
    two = both["d2"]
    assert (two["status"], two["reason"]) == (subtasks.HAND, subtasks.REASONS["hunks"])


def test_names():
    assert names.used("x = f(y)") == {"f", "y"} and names.used("if a and b(") == {"a", "b"}
    assert names.bound("from a.b import c as d, e") == {"c", "d", "e"} and names.bound("import a.b") == {"a"}
    assert {"f", "p", "q"} <= names.bound("def f(p, *q: int = 1): pass") and names.parameters("def f(p, *q: int = 1): pass") == {"p", "q"}
    assert names.bound("class C: x = 1") >= {"C", "x"} and names.bound("a == b") >= {"a"}


@pytest.mark.parametrize(("old", "new", "want"), [
    ("a\nb\nc\nd", "a\nb\nX\nc\nd", ["@@ -2,2 +2,3 @@\n b\n+X\n c"]),
    ("a\nb\nc", "a\nB\nc", ["@@ -1,3 +1,3 @@\n a\n-b\n+B\n c"]),
    ("a\nb\nc", "a\nc", ["@@ -1,3 +1,2 @@\n a\n-b\n c"]),
])
def test_generate(spark, old, new, want):
    row = ("t900-x", None, "fam", "d1", "data", "f.py", [1, 2], "s", "r", "ctx", {"f.py": old}, {"f.py": new})
    got = subtasks.generate(spark.createDataFrame([row], tasks.TEMPLATE)).first()
    assert got["diff"] == "diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n" + "\n".join(want) + "\n"
    assert got["gold"]["difficulty"] == "easy"


def test_a_path_in_two_sections_counts_on(spark):
    said = ["@@ -1 +1 @@ before any file", "+no", "diff --git a/a b/a", "+no", "@@ -1,2 +1,2 @@", " a", "-b", "+c", "@@ -9,0 +9 @@", "index 1..2", "diff --git a/b b/b", "@@ -5 +5 @@", "-x", "+++ b/b", "+y", "diff --git a/a b/a", "@@ -20 +30 @@", "", " z", "+w"]
    rows = diffs.parse(spark.createDataFrame([("t", "\n".join(said))], "task_id string, diff string")).orderBy("path", "hunk_no", "pos")
    got = [(r["path"], r["hunk_no"], r["pos"], r["prefix"], r["text"], r["old_no"], r["new_no"]) for r in rows.collect()]
    assert got == [("a", 1, 0, " ", "a", 1, 1), ("a", 1, 1, "-", "b", 2, None), ("a", 1, 2, "+", "c", None, 2), ("a", 3, 0, " ", "z", 20, 30), ("a", 3, 1, "+", "w", None, 31), ("b", 1, 0, "-", "x", 5, None), ("b", 1, 1, "+", "y", None, 5)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 3
