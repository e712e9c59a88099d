"""Shortest paths of a whole table of pairs at once, searched from both ends.

Each round every pair goes one hop further from that end whose frontier has fewer
edges, so hubs are expanded only where the other end offers nothing smaller. A
round is one join of all frontiers with the stored adjacency, whatever the number
of pairs; rounds are as many as the longest path wanted. What is kept of a hop are
its edges (node, node before), not path arrays. Nodes of one neighbour lie inside
no path, so they are left out unless a pair asks for them. Where both ends meet, the edges
that lie on a shortest path are picked back from the meeting nodes, and the path
is read off from the start, each time to the least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, stored
from .traverse import both_ways

#: Up to so many frontier rows are broadcast to the adjacency; more meet it by a shuffle.
BROADCAST_ROWS = 200_000


def adjacency(edges: DataFrame) -> DataFrame:
    """``a``, ``b``, ``type``: each edge from both ends, of parallel ones the least type; written once, by ``a``."""
    made = both_ways(edges).where("a is not null and b is not null and a <> b").groupBy("a", "b").agg(F.min("type").alias("type"))
    return stored(made.repartition("a").sortWithinPartitions("a"), "adjacency")


def passable(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """The adjacency without nodes of one neighbour, but for ends of pairs (start, goal)."""
    inner = near.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).where("degree > 1").select("a")
    ends = pairs.select(F.col("start").alias("a")).unionByName(pairs.select(F.col("goal").alias("a")))
    kept = inner.unionByName(ends).distinct()
    return near.join(kept.withColumnRenamed("a", "b"), "b", "left_semi").join(kept, "a", "left_semi").select("a", "b", "type")


def _joined(frontier: DataFrame, near: DataFrame, on: str) -> DataFrame:
    return near.join(F.broadcast(frontier) if frontier.count() <= BROADCAST_ROWS else frontier, on)


def shortest_paths(near: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """``start``, ``goal``, ``distance``, ``nodes``, ``relations``: the least path (by its node ids) of the fewest hops of each pair.

    ``near`` is the ``adjacency``, ``pairs`` has start and goal. Pairs without a path of
    ``most`` hops or fewer give no row, nor do pairs with a null end; a pair of one
    node has distance 0. Equal pairs give one row.
    """
    spark = near.sparkSession
    asked = pairs.select("start", "goal").where("start is not null and goal is not null").distinct()
    own = stored(asked.withColumn("pair", F.monotonically_increasing_id()), "pairs")  # numbers are fixed by being written
    near = stored(passable(near, own), "passable")
    degrees = stored(near.groupBy("a").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    side = lambda s, c: own.where("start <> goal").select("pair", F.lit(s).alias("side"), F.col(c).alias("node"), F.lit(0).alias("depth"))
    reached = cut(side(0, "start").unionByName(side(1, "goal")))
    # How far each pair has gone from its start and from its goal.
    open_pairs = cut(own.where("start <> goal").select("pair", F.lit(0).alias("d0"), F.lit(0).alias("d1")))
    kept = spark.createDataFrame([], "pair long, side int, node string, before string, type string, depth int")
    met = spark.createDataFrame([], "pair long, d0 int, d1 int, node string")
    for _ in range(most):
        edge = reached.join(open_pairs, "pair").where(F.col("depth") == F.when(F.col("side") == 0, F.col("d0")).otherwise(F.col("d1")))
        cost = edge.join(degrees, F.col("node") == F.col("a"), "left").groupBy("pair").pivot("side", [0, 1]).agg(F.sum("degree")).select("pair", F.col("0").alias("c0"), F.col("1").alias("c1"))
        # An end without edges has reached all it can: the pair has no path.
        turn = cost.where("c0 > 0 and c1 > 0").select("pair", F.when(F.col("c0") <= F.col("c1"), 0).otherwise(1).alias("side"))
        frontier = cut(edge.join(turn, ["pair", "side"]).select("pair", "side", "d0", "d1", F.col("node").alias("a")))
        if frontier.isEmpty():
            break
        step = _joined(frontier, near, "a").select("pair", "side", "d0", "d1", F.col("b").alias("node"), F.col("a").alias("before"), "type")
        depth = F.when(F.col("side") == 0, F.col("d0")).otherwise(F.col("d1")) + 1
        step = cut(step.join(reached.select("pair", "side", "node"), ["pair", "side", "node"], "left_anti").withColumn("depth", depth))
        kept = cut(kept.unionByName(step.select(*kept.columns)))
        fresh = step.select("pair", "side", "node", "depth").distinct()
        other = reached.select("pair", (1 - F.col("side")).alias("side"), "node")
        moved = step.select("pair", (F.col("d0") + F.when(F.col("side") == 0, 1).otherwise(0)).alias("d0"), (F.col("d1") + F.when(F.col("side") == 1, 1).otherwise(0)).alias("d1")).distinct()
        now = cut(fresh.join(other, ["pair", "side", "node"], "left_semi").select("pair", "node").distinct().join(moved, "pair").select(*met.columns))
        met = met.unionByName(now)
        reached = cut(reached.unionByName(fresh))
        open_pairs = cut(moved.join(now.select("pair").distinct(), "pair", "left_anti"))
        if open_pairs.isEmpty():
            break
    return _read_off(own, kept, cut(met), most)


def _read_off(own: DataFrame, kept: DataFrame, met: DataFrame, most: int) -> DataFrame:
    ends = met.groupBy("pair").agg(F.max("d0").alias("d0"), F.max("d1").alias("d1"))
    # From the meeting nodes back to the start: edges of the first half that lie on a shortest path.
    wanted = met.select("pair", "node", F.col("d0").alias("depth"))
    forward = kept.where("side = 0").join(ends.select("pair"), "pair", "left_semi").select("pair", F.col("before").alias("from"), F.col("node").alias("to"), "type", "depth")
    steps = None
    for _ in range(most):
        used = cut(forward.join(wanted.withColumnRenamed("node", "to"), ["pair", "to", "depth"]).select("pair", F.col("depth").alias("step"), "from", "to", "type"))
        steps = used if steps is None else steps.unionByName(used)
        wanted = used.select("pair", F.col("from").alias("node"), (F.col("step") - 1).alias("depth")).where("depth > 0").distinct()
        if wanted.isEmpty():
            break
    # The second half leads to the goal by every edge.
    back = kept.where("side = 1").join(ends, "pair").select("pair", (F.col("d0") + F.col("d1") - F.col("depth") + 1).alias("step"), F.col("node").alias("from"), F.col("before").alias("to"), "type")
    steps = back if steps is None else cut(steps.unionByName(back))
    at = own.join(ends, "pair").select("pair", F.col("start").alias("from"))
    path = at.select("pair", F.lit(0).alias("step"), F.col("from").alias("node"), F.lit(None).cast("string").alias("type"))
    for i in range(1, most + 1):
        nxt = steps.where(F.col("step") == i).join(at, ["pair", "from"]).groupBy("pair").agg(F.min(F.struct("to", "type")).alias("x"))
        nxt = cut(nxt.select("pair", F.col("x.to").alias("from"), F.col("x.type").alias("type")))
        if nxt.isEmpty():
            break
        path = path.unionByName(nxt.select("pair", F.lit(i).alias("step"), F.col("from").alias("node"), "type"))
        at = nxt.select("pair", "from")
    none = own.where("start = goal").select("start", "goal", F.lit(0).alias("distance"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("relations"))
    listed = path.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("step", "node", "type"))).alias("s"))
    made = listed.join(own, "pair").select("start", "goal", (F.size("s") - 1).alias("distance"), F.transform("s", lambda x: x["node"]).alias("nodes"), F.transform(F.slice("s", 2, most), lambda x: x["type"]).alias("relations"))
    return made.unionByName(none)
