"""Connected components over an edge table, with alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _state(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("child", "parent"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: (child, parent) with parent < child, repeats allowed. Returns one row for each node
    that isn't the smallest of its component: child, parent = that smallest node.

    Each round is written to the shared folder, so its lineage ends there. Nothing but a count and a
    checksum reaches the driver. Joins read written tables on both sides: a node with very many
    edges is a partition that Spark can split.
    """
    now = stored(edges.distinct(), "components")
    state = _state(now)
    while True:
        if not state[0]:
            return now
        # every table of a round has as many rows as now at most, but for small, which has twice as many
        least = stored(now.groupBy("child").agg(F.min("parent").alias("low")), "least", state[0])
        up = least.select(F.col("child").alias("parent"), "low")
        large = stored(now.join(up, "parent", "left").select("child", F.coalesce("low", "parent").alias("parent")).distinct(), "large", state[0])
        low = large.groupBy("child").agg(F.min("parent").alias("low"))
        both = large.join(low, "child")
        small = both.select("child", F.col("low").alias("parent")).unionByName(both.where("parent <> low").select(F.col("parent").alias("child"), F.col("low").alias("parent")))
        before, now = now, stored(small.distinct(), "components", 2 * state[0])
        dropped(before, least, large)
        last, state = state, _state(now)
        if state == last:
            return now
