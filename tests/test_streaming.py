from pyspark.sql import functions as F

from assayer.streaming.budget import running_budget


def test_running_budget_stream(spark, tmp_path):
    source, rows = tmp_path / "in", [("a", i, 4.0) for i in range(1, 5)] + [("b", 1, 1.0)]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, "ledger string, seq long, cost double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("ledger string, seq long, cost double").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = running_budget(stream).writeStream.format("memory").queryName("spent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("spent").where("ledger = 'a'").orderBy("seq").collect()
    assert len(got) == 4 and max(r["spent"] for r in got) == 16.0
    assert spark.table("spent").agg(F.count_if("exceeded")).first()[0] == 2
