import glob
import os

import pytest

from assayer import storage


def test_tables_are_kept_until_they_are_dropped(spark):
    first = storage.stored(spark.range(1000).repartition(7), "t")
    root = storage.shared_root(spark).removeprefix("file:")
    there = lambda: {os.path.basename(p) for p in glob.glob(f"{root}/t-*")}
    before = there()
    second = storage.stored(first.selectExpr("id * 2 AS id").repartition(5, "id"), "t", rows=500)
    assert second.count() == 1000 and len(there()) == len(before) + 1
    assert second.rdd.getNumPartitions() == 1, "the rows fit one file"
    storage.dropped(second, first.where("id > 3"))
    assert there() == before and first.count() == 1000


def test_settings_are_as_before(spark):
    key = storage._CLEAN
    before = spark.conf.get(key, None)
    storage.stored(spark.range(3), "t")
    assert spark.conf.get(key, None) == before


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_root(Cluster())
