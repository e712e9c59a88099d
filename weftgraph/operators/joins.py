"""Joins and components that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Keys with more than 1 / HOT_SHARE of all rows are hot: there are fewer than HOT_SHARE of them, whatever the data.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, lookup: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Inner join with a table that has each key once and counts its ``rows`` in ``n``; ``n`` goes.

    Hot keys, fewer than ``HOT_SHARE``, are joined by a broadcast, so that none of
    them makes a task; all others meet by a shuffle. Both tables are read twice:
    pass stored ones. Null keys match nothing.
    """
    total = lookup.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT_SHARE > total
    few, rest = F.broadcast(lookup.where(is_hot).drop(n)), lookup.where(~is_hot).drop(n)
    cold = rows.join(F.broadcast(lookup.where(is_hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(rest, key))


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node`` and ``component``, the least node that links (a, b) reach; nodes without a link are not listed.

    Large and small stars in turn until all links are stars; nothing is gathered by
    node, neighbours meet only their least one.
    """
    least, greatest = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(links.where("a <> b").select(greatest.alias("a"), least.alias("b")).distinct(), "links")

    def star(both: DataFrame, condition) -> DataFrame:
        """Each neighbour's link goes to the least node around its other end."""
        centre = stored(both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")), "centres")
        met = hot_join(both, centre.withColumn("low", F.least("a", "low")), "a")
        return met.where(condition).select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(centre.where("a > low").select("a", F.col("low").alias("b"))).where("a <> b")

    for _ in range(most_rounds):
        # A node with one link down and none up is a leaf, one with links up alone a centre.
        ends = edges.select("a", "b", F.explode(F.array(F.lit(1), F.lit(0))).alias("down")).select(F.when(F.col("down") == 1, F.col("a")).otherwise(F.col("b")).alias("node"), "down")
        sides = ends.groupBy("node").agg(F.sum("down").alias("downs"), F.min("down").alias("least"))
        if sides.where("downs > 1 or (downs = 1 and least = 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        large = stored(star(both, F.col("b") > F.col("a")).distinct(), "large")
        edges = stored(star(large, F.col("b") < F.col("a")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small")
    raise RuntimeError(f"links have not settled in {most_rounds} rounds")
