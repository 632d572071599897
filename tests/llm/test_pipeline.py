import os
import random

import pytest

import corpus_pipeline as cp
from assayer.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def corpus(spark):
    rng = random.Random(0)
    syllables = {"en": ["th", "ing", "ou", "wh"], "de": ["sch", "ung", "ü", "ei"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang, 80), lang, "s", 0, None) for i in range(60) for lang in ("en",)] + [(100 + i, text("de", 80), "de", "s", 0, None) for i in range(60)]
    rows += [(300, rows[0][1], "en", "s", 0, "copy"), (301, "12 34 %%", "en", None, None, None), (302, None, None, None, None, None), (303, "", "en", None, None, None)]
    rows += [(400, rows[3][1] + "\nmail bob@site.com now", "en", "s", 0, None), (None, text("en", 70), None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stages(spark):
    docs = corpus(spark)
    kept = cp.stored(cp.language(spark, docs, ""), "t")
    ids = {r["doc_id"] for r in kept.collect()}
    assert {301, 302, 303}.isdisjoint(ids) and {None, 300, 400} <= ids and kept.columns == docs.columns and len(ids) == docs.count() - 3
    lines = cp.stored(cp.lines(spark, kept, ""), "t")
    by = {r["doc_id"]: r for r in lines.collect()}
    assert 300 not in by and by[400]["text"] == "mail bob@site.com now" and by[400]["n_chars"] == len(by[400]["text"]) and lines.columns == docs.columns
    near = cp.stored(cp.near_duplicates(spark, lines, ""), "t")
    assert near.count() == lines.count() and near.columns == docs.columns
    # 300 is 0 again, 302 and 303 have no words, and 400 is 3 with three words more (a similarity of 0.96)
    left = {r["doc_id"] for r in cp.near_duplicates(spark, docs.unionByName(docs), "").collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {300, 303, 400}
    private = cp.stored(cp.personal_data(spark, near, ""), "t")
    assert {r["doc_id"]: r["text"] for r in private.collect()}[400] == "mail <EMAIL> now" and private.columns == docs.columns
    packed = cp.packing(spark, private, "")
    assert packed.select("doc_id").distinct().count() == private.select("doc_id").distinct().count()


def test_empty_table(spark):
    docs = corpus(spark).where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]
    assert cp.ORACLE_SQL is None
    assert sorted(queries.queries()) == sorted(f"op{n}_{x}" for n, x in zip(range(1, 11), ("langid", "warc", "pii", "lattice", "media", "packing", "line_dedup", "exact_dedup", "bpe", "simhash")))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_against_sql(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(sql).df()
        c = sorted(want.columns)
        say = lambda df: sorted(str([None if pd.isna(v) else v for v in r]) for r in df[c].astype(object).values.tolist())  # noqa: B023, E731
        assert sorted(got.columns) == c and [x.replace(".0", "") for x in say(got)] == [x.replace(".0", "") for x in say(want)], name


def test_the_way_files_are_split_changes_nothing(spark, tmp_path):
    mail = lambda i: f"person{i}@site{i}.com"
    text = lambda i: " ".join(f"w{i}_{j}" for j in range(40)) + f" write to {mail(i)} soon"
    rows = [(i if i % 5 else None, text(i % 60), None, None, i) for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6).write.parquet(f"{tmp_path}/docs")
    found = []
    for first, second in (("1k", "64m"), ("64m", "1k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", first)
        try:
            docs = spark.read.parquet(f"{tmp_path}/docs")
            one, private = cp.near_duplicates(spark, docs, ""), cp.personal_data(spark, docs, "")
            spark.conf.set("spark.sql.files.maxPartitionBytes", second)
            found.append((sorted(map(str, one.select("doc_id", "text").collect())), sorted(r["text"] for r in private.collect())))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len(found[0][0]) == 60
    assert all("<EMAIL> soon" in t and "@" not in t for t in found[0][1])


def test_frames_that_are_not_plain_scans_are_stored(spark, tmp_path):
    from pyspark.sql import functions as F

    from assayer.llm import common

    docs = corpus(spark)
    docs.write.parquet(f"{tmp_path}/docs")
    scan = spark.read.parquet(f"{tmp_path}/docs")
    assert common.scannable(scan) is scan
    plain = scan.where("doc_id > 3").select("text", F.col("doc_id").alias("_metadata"))
    assert common.scannable(plain) is plain and "rid" in common.with_row_key(plain).columns
    for other in (scan.unionByName(scan), scan.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), scan.withColumn("x", F.rand()), scan.join(scan.select("doc_id").distinct(), "doc_id"), docs, scan.limit(5)):
        kept = common.scannable(other)
        assert kept is not other
        keys = [r["rid"] for r in common.with_row_key(kept).collect()]
        assert len(set(keys)) == len(keys) == kept.count()
