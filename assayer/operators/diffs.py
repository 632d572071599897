"""Unified diffs as relations: parsing, numbering, ownership of changed lines, splitting, emitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONTEXT = 2
HUNK = ["task_id", "path", "hunk_no"]
#: Line ends as text tools see them.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
HEADER = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def git_path(line: Column) -> Column:
    """The new path of a `diff --git` line. Paths hold no spaces."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    last = F.element_at(words, -1)
    return F.substring(F.when(last.startswith("b/"), last).otherwise(F.try_element_at(words, F.lit(-2))), 3, 1 << 30)


def _number(line: Column, group: int) -> Column:
    got = F.regexp_extract(line, HEADER, group)
    whole = F.when(line.rlike(HEADER), F.when(got == "", "1").otherwise(got))
    return F.coalesce(whole, F.raise_error(F.concat(F.lit("malformed hunk header: "), line))).cast("int")


def parse(diffs: DataFrame, blank_is_context: bool = False) -> DataFrame:
    """diffs: task_id, diff. The line relation: task_id, path, hunk_no (from 1 in each path), pos (from
    0 in each hunk), prefix, text, the four numbers of the hunk's header, old_no and new_no.

    Lines before the first file and hunk, index lines, and body lines that look like file headers are
    skipped. Truly empty lines are skipped too, unless blank_is_context makes them context.
    """
    each = diffs.select("task_id", F.split("diff", LINE_ENDS).alias("lines"))
    lines = each.select("task_id", F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line"))
    if blank_is_context:
        lines = lines.withColumn("line", F.when((F.col("line") == "") & (F.col("at") < F.col("n") - 1), " ").otherwise(F.col("line")))
    starts = lambda *p: F.regexp_like("line", F.lit("^(?:" + "|".join(p) + ")"))
    rows = lines.select("task_id", "at", "line", starts("diff --git ").alias("is_file"), starts("@@").alias("is_hunk"))
    # two sorts carry all windows; a file without a hunk yet has an empty header
    upto = Window.partitionBy("task_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.last(F.when(F.col("is_file"), git_path(F.col("line"))), True).over(upto)
    header = F.last(F.when(F.col("is_file"), "").when(F.col("is_hunk"), F.col("line")), True).over(upto)
    rows = rows.withColumns({"path": path, "header": header}).where("path IS NOT NULL AND NOT is_file AND header <> ''")
    prefix = F.substring("line", 1, 1)
    is_line = ~F.col("is_hunk") & ~starts(r"\+\+\+ ", "--- ", "index ") & prefix.isin(" ", "+", "-")
    rows = rows.select("task_id", "path", "at", "is_hunk", "header", F.when(is_line, prefix).alias("prefix"), F.expr("substring(line, 2)").alias("text")).where("is_hunk OR prefix IS NOT NULL")
    for i, name in enumerate(("old_start", "old_count", "new_start", "new_count"), 1):
        rows = rows.withColumn(name, F.when(~F.col("is_hunk"), _number(F.col("header"), i)))
    # a path that has several sections numbers its hunks on
    of_path = Window.partitionBy("task_id", "path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda *marks: F.count(F.when(F.col("prefix").isin(*marks), 1)).over(of_path)
    rows = rows.drop("header").withColumns({"hunk_no": F.sum(F.when(F.col("is_hunk"), 1).otherwise(0)).over(of_path), "seen": F.struct(count(" ", "-", "+").alias("n"), count(" ", "-").alias("old"), count(" ", "+").alias("new"))})
    rows = rows.withColumn("before", F.last(F.when(F.col("is_hunk"), F.col("seen")), True).over(of_path)).where("NOT is_hunk")
    nth = lambda side: F.col(f"seen.{side}") - F.col(f"before.{side}") - 1
    number = lambda side, mark: F.when(F.col("prefix").isin(" ", mark), F.col(f"{side}_start") + nth(side)).cast("int").alias(f"{side}_no")
    return rows.select(*HUNK, "prefix", "text", "old_start", "old_count", "new_start", "new_count", nth("n").cast("int").alias("pos"), number("old", "-"), number("new", "+"))


def numbered(rows: DataFrame, hunk: list[str] = HUNK) -> DataFrame:
    """rows (hunk, pos, prefix, old_start, new_start) with old_no and new_no."""
    upto = Window.partitionBy(*hunk).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def number(start: str, mark: str) -> Column:
        has = F.col("prefix").isin(" ", mark)
        return F.when(has, F.col(start) - 1 + F.sum(F.when(has, 1).otherwise(0)).over(upto)).cast("int")

    return rows.withColumn("old_no", number("old_start", "-")).withColumn("new_no", number("new_start", "+"))


def positioned(lines: DataFrame, hunk: list[str] = HUNK) -> DataFrame:
    """lines with place, the new-file line that a changed line stands at: its own for an addition; for
    the k-th of adjacent deletions that of the k-th addition right after them, else the next line
    that the new file keeps."""
    order = Window.partitionBy(*hunk).orderBy("pos")
    before = F.lag("prefix").over(order)
    begins = ((F.col("prefix") == "-") & (F.coalesce(before, F.lit(" ")) != "-")) | ((F.col("prefix") == "+") & (F.coalesce(before, F.lit(" ")) == " "))
    rows = lines.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*hunk, "run", "prefix").orderBy("pos")))
    changed = F.col("prefix") != " "
    pair = F.max(F.when(F.col("prefix") == "+", F.col("new_no"))).over(Window.partitionBy(*hunk, "run", "k"))
    onward = F.first("new_no", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    place = F.when(F.col("prefix") == "+", F.col("new_no")).when(changed, F.coalesce(pair, onward))
    return rows.withColumn("place", place).drop("run", "k")


def owners(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """lines (with place) joined to the spans (task_id, defect_id, path, lo, hi) that cover them; a line
    in two spans comes twice. Equality of task and path carries the join, the range is its residue."""
    s = spans.withColumnRenamed("path", "_path").withColumnRenamed("task_id", "_task")
    return lines.join(s, (F.col("task_id") == F.col("_task")) & (F.col("path") == F.col("_path")) & F.col("place").between(F.col("lo"), F.col("hi"))).drop("_task", "_path", "lo", "hi")


def conflicts(owned: DataFrame) -> DataFrame:
    """Changed lines that more than one defect owns."""
    return owned.groupBy(*HUNK, "pos").agg(F.array_sort(F.collect_set("defect_id")).alias("defects")).where(F.size("defects") > 1)


def with_context(rows: DataFrame, key: list[str], context: int = CONTEXT) -> DataFrame:
    """rows (key, pos, prefix, owned) with kept: owned lines and the context within reach of one."""
    near = F.max(F.col("owned").cast("int")).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(-context, context))
    return rows.withColumn("kept", F.col("owned") | ((F.col("prefix") == " ") & (near == 1)))


def split_runs(rows: DataFrame, key: list[str], insertion_after_first: bool = False) -> DataFrame:
    """rows (key, pos, prefix, text, old_no, new_no, header numbers, kept) as sub-hunks, one row each:
    key, run, old_start, old_count, new_start, new_count, lines.

    A sub-hunk is a maximal run of kept lines without a gap in old numbers and with a change. Runs of
    additions only stand after the last old line before them (after the hunk's first old line with
    insertion_after_first); runs of deletions only where the new file goes on after the next line that has an old number.
    """
    order = Window.partitionBy(*key).orderBy("pos")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    dropped = F.sum(F.when(~F.col("kept"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    old_before = F.last("old_no", True).over(ahead)
    first_old = F.first("old_no", True).over(ahead)
    # the new number at or after the next line that has an old one
    onward = F.first("new_no", True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    last_new = F.first(F.when(F.col("old_no").isNotNull(), F.struct(F.col("onward").alias("n"))), True).over(order.rowsBetween(1, Window.unboundedFollowing))["n"]
    marked = rows.withColumn("onward", onward).withColumn("drops", dropped).withColumn("old_before", old_before).withColumn("first_old", first_old).withColumn("new_after", last_new).where("kept")
    in_run = Window.partitionBy(*key, "drops").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.col("old_no") != F.last("old_no", True).over(in_run) + 1, F.lit(False))
    marked = marked.withColumn("gap", gap).withColumn("run", F.struct("drops", F.sum(F.when(F.col("gap"), 1).otherwise(0)).over(in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("gaps")))
    ends = F.max_by(F.struct("new_after"), "pos")["new_after"]
    at = F.min_by(F.struct("old_before", "first_old"), "pos")
    before = at["first_old"] if insertion_after_first else at["old_before"]
    return marked.groupBy(*key, "run").agg(
        F.coalesce(F.min("old_no"), before + 1, F.first("old_start")).alias("old_start"),
        F.count("old_no").cast("int").alias("old_count"),
        F.coalesce(F.min("new_no"), ends, F.first("new_start") + F.first("new_count")).alias("new_start"),
        F.count("new_no").cast("int").alias("new_count"),
        F.bool_or(F.col("prefix") != " ").alias("changed"),
        F.array_sort(F.collect_list(F.struct("pos", "prefix", "text", "old_no", "new_no"))).alias("lines"),
    ).where("changed").drop("changed")


def whole_hunks(rows: DataFrame, key: list[str]) -> DataFrame:
    """Hunks of line rows as they are, in the shape of split_runs."""
    return rows.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("old_start", "old_count", "new_start", "new_count")],
        F.array_sort(F.collect_list(F.struct("pos", "prefix", "text", "old_no", "new_no"))).alias("lines"),
    )


def hunk_text() -> Column:
    head = F.format_string("@@ -%d,%d +%d,%d @@", "old_start", "old_count", "new_start", "new_count")
    return F.array_join(F.concat(F.array(head), F.transform("lines", lambda x: F.concat(x["prefix"], x["text"]))), "\n")


def emit(hunks: DataFrame, key: list[str]) -> DataFrame:
    """key and diff: hunks (key, path, place, header numbers, lines) written out, paths in order, hunks
    by place. Old and new names of a file are the same."""
    files = hunks.groupBy(*key, "path").agg(F.array_sort(F.collect_list(F.struct("place", hunk_text().alias("said")))).alias("said"))
    head = F.format_string("diff --git a/%s b/%s\n--- a/%s\n+++ b/%s", *["path"] * 4)
    text = F.concat_ws("\n", head, F.array_join(F.transform("said", lambda x: x["said"]), "\n"))
    return files.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("path", text.alias("said")))).alias("files")).select(*key, F.concat(F.array_join(F.transform("files", lambda x: x["said"]), "\n"), F.lit("\n")).alias("diff"))


def anchors(hunks: DataFrame, key: list[str]) -> DataFrame:
    """key, lo, hi: the hunk with the most changed lines (the first of equals) gives the span of its
    additions, or its whole new span if it only deletes; a hunk without new lines is not eligible."""
    # numbers follow the hunk's own header
    walked = F.aggregate(
        "lines",
        F.struct(F.col("new_start").alias("n"), F.array().cast("array<int>").alias("plus"), F.lit(0).alias("changes")),
        lambda a, x: F.struct(
            F.when(x["prefix"] == "-", a["n"]).otherwise(a["n"] + 1).alias("n"),
            F.when(x["prefix"] == "+", F.concat(a["plus"], F.array(a["n"]))).otherwise(a["plus"]).alias("plus"),
            F.when(x["prefix"] == " ", a["changes"]).otherwise(a["changes"] + 1).alias("changes"),
        ),
    )
    rows = hunks.withColumn("w", walked)
    span = F.when(F.size("w.plus") > 0, F.struct(F.array_min("w.plus").alias("lo"), F.array_max("w.plus").alias("hi"))).when(F.col("new_count") > 0, F.struct(F.col("new_start").alias("lo"), (F.col("new_start") + F.col("new_count") - 1).alias("hi")))
    best = F.max_by("span", F.struct(F.col("w.changes"), -F.col("place")))
    return rows.withColumn("span", span).where("span IS NOT NULL").groupBy(*key).agg(best.alias("span")).select(*key, "span.lo", "span.hi")
