"""Contracts as declarative constraints: each row gets its violations, in the order of the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import GENERAL, is_verbatim, strip
from ..storage import stored

#: Closed vocabularies of the data model.
CATEGORIES = ["concurrency", "data", "contracts", "resilience", "architecture", "operability", "security", "authorization", "injection", "traversal"]
LICENSES = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "ISC", "Unlicense", "CC0-1.0"]
#: difficulty: fewest and most defects, fewest and most distractors (null: any number), distinct categories.
RULES = [("easy", 1, 1, 0, 1, False), ("medium", 2, 2, 1, None, True), ("hard", 3, 4, 2, None, True)]
GOLD_KEYS = ["id", "difficulty", "source", "defects", "distractors"]
DEFECT_KEYS = ["id", "category", "file", "lines", "summary", "rationale"]
DISTRACTOR_KEYS = ["id", "file", "lines", "concern", "why_ok"]

SPAN = "id string, category string, file string, lines array<string>, summary string, rationale string"
GOLD = f"id string, difficulty string, source map<string,string>, defects array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>, distractors array<struct<id:string,file:string,lines:array<string>,concern:string,why_ok:string>>, prompt_notes string"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "difficulty string, defect_lo int, defect_hi int, distractor_lo int, distractor_hi int, distinct_categories boolean")


def _first(checks: list[tuple[Column, Column | str]]) -> Column:
    """The messages of the checks that fail, in order; a check that can't be decided fails."""
    said = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for ok, m in checks]
    return F.array_compact(F.array(*said))


def good_lines(lines: Column) -> Column:
    """Two whole numbers, 1 <= first <= last. Booleans and text aren't numbers."""
    lo, hi = F.try_element_at(lines, F.lit(1)).try_cast("int"), F.try_element_at(lines, F.lit(2)).try_cast("int")
    return (F.size(lines) == 2) & F.forall(lines, lambda x: x.rlike("^-?[0-9]+$")) & (lo >= 1) & (lo <= hi)


def dense(ids: Column, prefix: str) -> Column:
    """Whether ids are prefix1, prefix2 and so on."""
    return F.forall(F.transform(ids, lambda x, i: x == F.concat(F.lit(prefix), (i + 1).cast("string"))), lambda x: x)


def validate_gold(golds: DataFrame) -> DataFrame:
    """golds: directory, gold (JSON). With gold as a struct, violations (the first is what a strict
    reader reports) and valid. Files are trimmed in the struct."""
    raw = F.col("gold")
    keys = F.json_object_keys(raw)
    sub = lambda path: F.from_json(F.get_json_object(raw, path), "array<string>")
    rows = golds.withColumn("g", F.from_json("gold", GOLD, {"mode": "PERMISSIVE"})).withColumn("keys", keys)
    rows = rows.withColumn("raw_defects", sub("$.defects")).withColumn("raw_distractors", sub("$.distractors"))
    kind, extra = F.col("g.source")["kind"], F.map_keys("g.source")
    has = lambda arr, need: F.size(F.array_except(F.array(*[F.lit(k) for k in need]), arr)) == 0
    only = lambda arr, may: F.size(F.array_except(arr, F.array(*[F.lit(k) for k in may]))) == 0
    each = lambda c, test: F.forall(c, lambda x: test(F.json_object_keys(x)))
    table = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(r, ("string", "int", "int", "int", "int", "boolean"), ("difficulty", "a", "b", "c", "d", "e"))]) for r in RULES])
    rule = F.filter(table, lambda r: r["difficulty"] == F.col("g.difficulty"))[0]
    rows = rows.withColumn("rule", F.when(F.col("g.difficulty").isin([r[0] for r in RULES]), rule))
    n, m = F.size("g.defects"), F.size("g.distractors")
    categories = F.transform("g.defects", lambda d: d["category"])
    checks: list[tuple[Column, Column | str]] = [
        (F.col("keys").isNotNull(), "gold must be a mapping"),
        (has(F.col("keys"), GOLD_KEYS), "gold misses keys"),
        (F.col("g.id") == F.col("directory"), "gold id differs from directory name"),
        (F.col("rule").isNotNull(), "unknown difficulty"),
        (kind.isNotNull(), "source must be a mapping with a kind"),
        (kind.isin("synthetic", "oss"), "unknown source kind"),
        ((kind != "synthetic") | (F.size(extra) == 1), "synthetic source carries extra fields"),
        ((kind != "oss") | has(extra, ["url", "license", "attribution"]), "oss source misses a field"),
        ((kind != "oss") | F.col("g.source")["license"].isin(LICENSES), "license isn't permissive"),
        ((kind != "oss") | only(extra, ["kind", "url", "license", "attribution"]), "oss source has unknown fields"),
        (F.col("raw_defects").isNotNull() & F.col("raw_distractors").isNotNull(), "defects or distractors aren't arrays"),
        (n.between(1, 4), "defects must number 1 to 4"),
        (each("raw_defects", lambda k: has(k, DEFECT_KEYS)), "defect misses a key"),
        (each("raw_defects", lambda k: only(k, DEFECT_KEYS)), "defect has unknown keys"),
        (F.forall(categories, lambda c: c.isin(CATEGORIES)), "unknown category"),
        (F.forall("g.defects", lambda d: good_lines(d["lines"])), "defect lines must be two numbers, 1 <= start <= end"),
        (each("raw_distractors", lambda k: has(k, DISTRACTOR_KEYS)), "distractor misses a key"),
        (each("raw_distractors", lambda k: only(k, DISTRACTOR_KEYS)), "distractor has unknown keys"),
        (F.forall("g.distractors", lambda d: d["lines"].isNull() | good_lines(d["lines"])), "distractor lines must be two numbers, 1 <= start <= end"),
        (n.between(F.col("rule.a"), F.col("rule.b")), "number of defects doesn't fit the difficulty"),
        ((m >= F.col("rule.c")) & (F.col("rule.d").isNull() | (m <= F.col("rule.d"))), "number of distractors doesn't fit the difficulty"),
        (~F.col("rule.e") | (F.size(F.array_distinct(categories)) == n), "defect categories must be distinct"),
        (dense(F.transform("g.defects", lambda d: d["id"]), "d"), "defect ids must be d1, d2, ..."),
        (dense(F.transform("g.distractors", lambda d: d["id"]), "x"), "distractor ids must be x1, x2, ..."),
        (only(F.col("keys"), [*GOLD_KEYS, "prompt_notes"]), "gold has unknown keys"),
    ]
    rows = rows.withColumn("violations", _first(checks))
    trimmed = lambda c: F.transform(c, lambda d: d.withField("file", strip(d["file"])))
    whole = F.col("g").withField("defects", trimmed("g.defects")).withField("distractors", trimmed("g.distractors")).withField("prompt_notes", F.coalesce("g.prompt_notes", F.lit("")))
    return rows.withColumn("gold", whole).withColumn("valid", F.size("violations") == 0).drop("g", "keys", "raw_defects", "raw_distractors", "rule")


def validate_claims(extractions: DataFrame, verbatim_quotes: bool = True) -> DataFrame:
    """extractions: file_list, claims (array of id, file, quote, summary), review. With violations, in
    claim order, and valid. Gold is no input. A quote of backticks only passes."""
    claim = lambda c: F.array_compact(F.array(
        F.when(~(F.array_contains("file_list", strip(c["file"])) | (strip(c["file"]) == GENERAL)), F.concat(c["id"], F.lit(": file isn't in the diff"))),
        F.when(strip(c["quote"]) == "", F.concat(c["id"], F.lit(": empty quote"))),
        *([F.when(F.col("review").isNotNull() & ~is_verbatim(strip(c["quote"]), F.col("review")), F.concat(c["id"], F.lit(": quote isn't verbatim")))] if verbatim_quotes else []),
        F.when(strip(c["summary"]) == "", F.concat(c["id"], F.lit(": empty summary"))),
    ))
    ids = F.when(~dense(F.transform("claims", lambda c: c["id"]), "c"), F.array(F.lit("claim ids must be c1, c2, ..."))).otherwise(F.array().cast("array<string>"))
    rows = extractions.withColumn("violations", F.concat(ids, F.flatten(F.transform("claims", claim))))
    return rows.withColumn("valid", F.size("violations") == 0)


def validate_verdicts(traces: DataFrame, claims: DataFrame, verdicts: DataFrame, defects: DataFrame, distractors: DataFrame) -> DataFrame:
    """trace_id, violations (verdicts in order, then claims without one), valid.

    traces: trace_id, task_id. claims: trace_id, claim_id. verdicts: trace_id, pos, claim_id, kind,
    defect_id, second_defect_id, distractor_file. defects: task_id, defect_id. distractors: task_id,
    file. Distractors are told by file. All memberships are equi-joins; none is quadratic in a trace.
    """
    own = verdicts.join(traces, "trace_id")
    known = claims.select("trace_id", "claim_id").distinct().withColumn("has_claim", F.lit(True))
    gold = defects.select("task_id", "defect_id").distinct()
    files = distractors.select("task_id", F.col("file").alias("distractor_file")).distinct().withColumn("has_file", F.lit(True))
    from pyspark.sql.window import Window

    rows = own.withColumn("nth", F.row_number().over(Window.partitionBy("trace_id", "claim_id").orderBy("pos")))
    rows = rows.join(known, ["trace_id", "claim_id"], "left").join(files, ["task_id", "distractor_file"], "left")
    rows = rows.join(gold.withColumn("has_first", F.lit(True)), ["task_id", "defect_id"], "left")
    rows = rows.join(gold.select("task_id", F.col("defect_id").alias("second_defect_id")).withColumn("has_second", F.lit(True)), ["task_id", "second_defect_id"], "left")
    matched = F.col("kind") == "matched"
    second = F.col("second_defect_id").isNotNull()
    said = (
        F.when(F.col("has_claim").isNull(), "verdict references an unknown claim")
        .when(F.col("nth") > 1, "claim has more than one verdict")
        .when(matched & F.col("defect_id").isNull(), "matched verdict has no defect")
        .when(matched & F.col("has_first").isNull(), "verdict credits an unknown defect")
        .when(matched & second & F.col("has_second").isNull(), "verdict credits an unknown defect")
        .when(matched & second & (F.col("second_defect_id") == F.col("defect_id")), "verdict credits the same defect twice")
        .when((F.col("kind") == "distractor") & F.col("has_file").isNull(), "distractor verdict cites an unknown file")
        .when(~F.col("kind").isin("matched", "distractor", "false_alarm"), "verdict has an invalid kind")
    )
    bad = rows.select("trace_id", F.col("pos").cast("long").alias("pos"), said.alias("reason")).where("reason IS NOT NULL")
    silent = known.join(verdicts.select("trace_id", "claim_id").distinct(), ["trace_id", "claim_id"], "left_anti")
    bad = bad.unionByName(silent.select("trace_id", F.lit((1 << 62)).alias("pos"), F.lit("claim has no verdict").alias("reason")))
    per = bad.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "reason"))), lambda x: x["reason"]).alias("violations"))
    out = traces.select("trace_id").join(per, "trace_id", "left").withColumn("violations", F.coalesce("violations", F.array().cast("array<string>")))
    return out.withColumn("valid", F.size("violations") == 0)


def strict(checked: DataFrame) -> DataFrame:
    """The rows, or an error with the first violation. They are written, as in quarantine()."""
    return stored(checked.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.col("violations")[0]))), "strict")


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their violations). The rows are written first: a filter on valid would
    move below what it is made of, which then is made anew wherever a rule names it, and on either side."""
    checked = stored(checked, "checked")
    return checked.where("valid").drop("violations", "valid"), checked.where(~F.col("valid"))


def validate_rates(rates: DataFrame) -> DataFrame:
    ok = (F.col("input_per_1m") >= 0) & (F.col("output_per_1m") >= 0)
    return rates.withColumn("violations", _first([(ok, "negative price")])).withColumn("valid", F.size("violations") == 0)
