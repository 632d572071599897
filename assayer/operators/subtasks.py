"""Decomposition of tasks with several defects into one task for each, and generation from templates."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import delimiter_balance, looks_like_binding, pruned_context, strip
from ..storage import dropped, stored
from . import diffs
from .names import BUILTINS, bound_names, parameter_names, used_names

SUB = ["task_id", "defect_id"]
HAND, CLEAN = "needs-hand-write", "clean"
REASONS = {
    "hunks": "the split left no hunk",
    "change": "none of the lines is a change",
    "balance": "brackets of the changed lines don't match up",
    "closure": "a name in use is bound by the parent's other changes",
    "anchor": "no line to anchor the defect at",
}


def gold_defects(golds: DataFrame) -> DataFrame:
    """task_id, defect_id, ord, category, path, lo, hi, summary, rationale of validated golds."""
    d = golds.select(F.col("gold.id").alias("task_id"), F.posexplode("gold.defects").alias("ord", "d"))
    number = lambda i: F.element_at("d.lines", i).cast("int")
    return d.select("task_id", F.col("d.id").alias("defect_id"), "ord", "d.category", F.col("d.file").alias("path"), number(1).alias("lo"), number(2).alias("hi"), "d.summary", "d.rationale")


def split_by_defect(lines: DataFrame, defects: DataFrame, insertion_after_first: bool = False) -> DataFrame:
    """Sub-hunks of each defect: task_id, defect_id, path, place, header numbers, lines. A defect alone
    in its file keeps the file's hunks; others keep the lines that they own, with context."""
    alone = F.count("*").over(Window.partitionBy("task_id", "path")) == 1
    named = defects.withColumn("alone", alone)
    mine = named.select(*SUB, "path", "alone")
    own = [*SUB, *diffs.HUNK[1:]]
    here = lines.join(mine, ["task_id", "path"])
    whole = diffs.whole_hunks(here.where("alone"), own)
    placed = diffs.positioned(lines)
    owned = diffs.owners(placed, named.where(~F.col("alone")).select(*SUB, "path", "lo", "hi"))
    marks = owned.select(*SUB, "path", "hunk_no", "pos").withColumn("owned", F.lit(True))
    rows = here.where(~F.col("alone")).join(marks, [*own, "pos"], "left").withColumn("owned", F.coalesce("owned", F.lit(False)))
    parts = diffs.split_runs(diffs.with_context(rows, own), own, insertion_after_first)
    columns = [*SUB, "path", "place", "old_start", "old_count", "new_start", "new_count", "lines"]
    first = whole.withColumn("place", F.struct(F.lit(0).alias("start"), "hunk_no", F.lit(0).cast("long").alias("drops"), F.lit(0).cast("long").alias("gaps")))
    rest = parts.withColumn("place", F.struct(F.lit(0).alias("start"), "hunk_no", F.col("run.drops").cast("long").alias("drops"), F.col("run.gaps").cast("long").alias("gaps")))
    both = first.select(columns).unionByName(rest.select(columns))
    order = Window.partitionBy(*SUB).orderBy("place")
    return both.withColumn("place", F.row_number().over(order))


def added_names(hunks: DataFrame) -> DataFrame:
    """task_id, defect_id, unbound: names that added lines load and neither they nor the language bind."""
    added = hunks.select(*SUB, F.explode("lines").alias("x")).where("x.prefix = '+'").select(*SUB, strip(F.col("x.text")).alias("code"))
    each = added.select(*SUB, used_names("code").alias("u"), bound_names("code").alias("b"))
    sets = each.groupBy(*SUB).agg(F.array_distinct(F.flatten(F.collect_list("u"))).alias("u"), F.array_distinct(F.flatten(F.collect_list("b"))).alias("b"))
    known = F.array(*[F.lit(n) for n in BUILTINS])
    return sets.select(*SUB, F.array_except(F.array_except("u", "b"), known).alias("unbound")).where(F.size("unbound") > 0)


def close_names(hunks: DataFrame, lines: DataFrame, defects: DataFrame) -> DataFrame:
    """hunks with one more for each defect whose added lines need names that other lines of the file
    bind: those lines, unless another defect owns them, each with a deletion right before it."""
    need = added_names(hunks).join(defects.select(*SUB, "path"), SUB)
    order = Window.partitionBy(*diffs.HUNK).orderBy("pos")
    before = F.lag(F.struct("prefix", "text", "old_no", "new_no", "pos")).over(order)
    placed = diffs.positioned(lines)
    body = strip(F.col("text"))
    binding = placed.withColumn("before", before).where(F.col("prefix").isin("+", "-") & ~body.rlike("^(?:def |class |async def )") & looks_like_binding(F.col("text")))
    binding = binding.withColumn("binds", bound_names("text"))
    found = binding.join(need, ["task_id", "path"]).where(F.arrays_overlap("binds", "unbound"))
    others = diffs.owners(placed, defects.select(*SUB, "path", "lo", "hi")).select("task_id", F.col("defect_id").alias("other"), "path", "hunk_no", "pos")
    foreign = found.join(others, ["task_id", "path", "hunk_no", "pos"]).where(F.col("other") != F.col("defect_id")).select(*SUB, "path", "hunk_no", "pos").distinct()
    found = found.join(foreign, [*SUB, "path", "hunk_no", "pos"], "left_anti")
    line = F.struct("prefix", "text", "old_no", "new_no", "pos")
    pair = F.when(F.col("before.prefix") == "-", F.array("before", line)).otherwise(F.array(line))
    extra = found.select(*SUB, "path", "hunk_no", F.explode(pair).alias("x")).select(*SUB, "path", "hunk_no", "x.*")
    extra = extra.groupBy(*SUB, "path", "old_no", "prefix", "text").agg(F.min(F.struct("hunk_no", "pos", "new_no")).alias("first"))
    entry = F.struct(F.coalesce("old_no", F.lit(0)).alias("at"), F.col("first.hunk_no").alias("hunk_no"), F.col("first.pos").alias("pos"), "prefix", "text", "old_no", F.col("first.new_no").alias("new_no"))
    pulled = extra.groupBy(*SUB, "path").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    numbers = lambda c: F.filter(F.transform("found", lambda x: x[c]), lambda n: n.isNotNull())
    start = lambda c: F.coalesce(F.try_element_at(numbers(c), F.lit(1)), F.lit(0))
    more = pulled.select(
        *SUB, "path", F.lit(1 << 20).alias("place"), start("old_no").alias("old_start"), F.size(numbers("old_no")).alias("old_count"), start("new_no").alias("new_start"), F.size(numbers("new_no")).alias("new_count"),
        F.transform("found", lambda x, i: F.struct(i.alias("pos"), x["prefix"].alias("prefix"), x["text"].alias("text"), x["old_no"].alias("old_no"), x["new_no"].alias("new_no"))).alias("lines"),
    )
    merged = hunks.unionByName(more)
    touched = more.select(*SUB).distinct().withColumn("_more", F.lit(True))
    merged = merged.join(touched, SUB, "left")
    by = Window.partitionBy(*SUB).orderBy(F.when(F.col("_more"), F.col("new_start")).otherwise(F.lit(0)), "place")
    return merged.withColumn("place", F.row_number().over(by)).drop("_more")


def status(hunks: DataFrame, lines: DataFrame, defects: DataFrame) -> DataFrame:
    """task_id, defect_id, lo, hi, status, reason, shared (whether another defect owns one of its
    changed lines; a warning). The reasons are tried in order."""
    changed = hunks.select(*SUB, F.explode("lines").alias("x")).where("x.prefix <> ' '")
    balance = changed.groupBy(*SUB).agg(F.sum(delimiter_balance(F.col("x.text"))).alias("balance"))
    parent = lines.where("prefix <> ' '").withColumn("code", strip(F.col("text")))
    parent = parent.select("task_id", "path", F.explode(F.array_except(bound_names("code"), parameter_names("code"))).alias("name")).distinct()
    loose = added_names(hunks).join(defects.select(*SUB, "path"), SUB).select(*SUB, "path", F.explode("unbound").alias("name"))
    leak = loose.join(parent, ["task_id", "path", "name"], "left_semi").select(*SUB).distinct().withColumn("leak", F.lit(True))
    owned = diffs.owners(diffs.positioned(lines), defects.select(*SUB, "path", "lo", "hi"))
    shared = diffs.conflicts(owned).select("task_id", F.explode("defects").alias("defect_id")).distinct().withColumn("shared", F.lit(True))
    any_hunk = hunks.select(*SUB).distinct().withColumn("some", F.lit(True))
    out = defects.select(*SUB).join(any_hunk, SUB, "left").join(balance, SUB, "left").join(leak, SUB, "left").join(diffs.anchors(hunks, SUB), SUB, "left").join(shared, SUB, "left")
    why = (
        F.when(F.col("some").isNull(), REASONS["hunks"])
        .when(F.col("balance").isNull(), REASONS["change"])
        .when(F.col("balance") != 0, REASONS["balance"])
        .when(F.col("leak"), REASONS["closure"])
        .when(F.col("lo").isNull() | (F.col("lo") < 1), REASONS["anchor"])
    )
    return out.select(*SUB, "lo", "hi", F.when(why.isNull(), CLEAN).otherwise(HAND).alias("status"), why.alias("reason"), F.coalesce("shared", F.lit(False)).alias("shared"))


def decompose(tasks: DataFrame, insertion_after_first: bool = False, blank_is_context: bool = False) -> DataFrame:
    """tasks: task_id, diff, context, gold (validated struct). One row for each defect: id, parent,
    parent_defect, diff, context, gold (struct), status, reason, shared.

    What several branches read is written to the shared folder first, so that no branch repeats it."""
    defects = stored(gold_defects(tasks), "defects")
    lines = stored(diffs.parse(tasks.select("task_id", "diff"), blank_is_context), "lines")
    split = stored(split_by_defect(lines, defects, insertion_after_first), "split")
    hunks = stored(close_names(split, lines, defects), "hunks")
    text = stored(diffs.emit(hunks, SUB), "texts")
    state = stored(status(hunks, lines, defects), "states")
    dropped(lines, split, hunks)
    whole = tasks.select("task_id", F.col("context").alias("parent_context"), "gold")
    rows = defects.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).join(state, SUB).join(text, SUB, "left").join(whole, "task_id")
    others = F.array_distinct(F.filter(F.transform("gold.defects", lambda d: d["file"]), lambda f: f != F.col("path")))
    same = F.slice(F.filter("gold.distractors", lambda x: x["file"] == F.col("path")), 1, 1)
    lines_of = F.when(F.col("lo").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("lo").cast("string"), F.col("hi").cast("string")))
    sub_id = F.concat_ws("-", "task_id", "defect_id")
    gold = F.struct(
        sub_id.alias("id"),
        F.lit("easy").alias("difficulty"),
        F.col("gold.source").alias("source"),
        F.array(F.struct(F.lit("d1").alias("id"), "category", F.col("path").alias("file"), lines_of.alias("lines"), "summary", "rationale")).alias("defects"),
        F.transform(same, lambda x: x.withField("id", F.lit("x1"))).alias("distractors"),
        F.coalesce("gold.prompt_notes", F.lit("")).alias("prompt_notes"),
    )
    return rows.select(sub_id.alias("id"), F.col("task_id").alias("parent"), F.col("defect_id").alias("parent_defect"), F.coalesce("diff", F.lit("\n")).alias("diff"), pruned_context(F.col("parent_context"), F.col("path"), others).alias("context"), gold.alias("gold"), "status", "reason", "shared")


def gold_json(gold: Column) -> Column:
    """A gold struct as JSON with line numbers as numbers, for validation and for files."""
    number = lambda c: F.transform(c, lambda d: d.withField("lines", F.transform(d["lines"], lambda x: x.cast("int"))))
    return F.to_json(gold.withField("defects", number(gold["defects"])).withField("distractors", number(gold["distractors"])), {"ignoreNullFields": "false"})


_HUNKS = "array<struct<old_start:int,old_count:int,new_start:int,new_count:int,lines:array<struct<pos:int,prefix:string,text:string,old_no:int,new_no:int>>>>"


def file_hunks(base, changed, context=1):
    """Hunks between two texts, one for each changed block, with a line of context on either side."""
    a, b = base.splitlines(), changed.splitlines()
    out = []
    for kind, i, i2, j, j2 in difflib.SequenceMatcher(a=a, b=b).get_opcodes():
        if kind == "equal":
            continue
        top, bottom = min(context, i, j), min(context, len(a) - i2, len(b) - j2)
        said = [*((" ", x) for x in a[i - top : i]), *(("-", x) for x in a[i:i2]), *(("+", x) for x in b[j:j2]), *((" ", x) for x in a[i2 : i2 + bottom])]
        lines = [(n, p, t, None, None) for n, (p, t) in enumerate(said)]
        out.append((i - top + 1, top + (i2 - i) + bottom, j - top + 1, top + (j2 - j) + bottom, lines))
    return out


def generate(templates: DataFrame) -> DataFrame:
    """templates (id, difficulty, family, defect_id, category, file, lines, summary, rationale, context,
    base, defective) as tasks: id, diff, context, family, gold. Each deleted line is written once."""
    cut = F.udf(file_hunks, _HUNKS)
    files = templates.select("id", F.explode("base").alias("path", "old"), "defective").select("id", "path", F.explode(cut("old", F.coalesce(F.col("defective")[F.col("path")], F.lit("")))).alias("h"))
    hunks = files.select("id", "path", "h.*").withColumn("place", F.struct("new_start", "old_start"))
    text = diffs.emit(hunks, ["id"])
    defect = F.struct(F.col("defect_id").alias("id"), "category", "file", F.transform("lines", lambda x: x.cast("string")).alias("lines"), "summary", "rationale")
    no_distractors = F.array().cast("array<struct<id:string,file:string,lines:array<string>,concern:string,why_ok:string>>")
    gold = F.struct("id", F.coalesce("difficulty", F.lit("easy")).alias("difficulty"), F.create_map(F.lit("kind"), F.lit("synthetic")).alias("source"), F.array(defect).alias("defects"), no_distractors.alias("distractors"), F.lit("").alias("prompt_notes"))
    return templates.join(text, "id", "left").select("id", F.coalesce("diff", F.lit("\n")).alias("diff"), "context", F.coalesce("family", F.lit("")).alias("family"), gold.alias("gold"))
