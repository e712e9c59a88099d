"""Traversal of an edge table (src, type, dst), edges taken in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type"))


def ball(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``id`` and ``depth`` of all nodes within ``hops`` of ``seeds`` (id).

    One equi-join a hop; nodes are made distinct before the next, so hubs are
    expanded once. Lineage is cut at each hop; a frontier without nodes ends it.
    """
    doubled = both_ways(edges).select("a", "b")
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for hop in range(1, max(1, hops) + 1):
        step = frontier.join(doubled, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nearest nodes (by depth, then id) and the edges among them."""
    nodes = cut(ball(edges, seeds, hops).orderBy("depth", "id").limit(max(1, limit)))
    return nodes, induced(edges, nodes)


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = 5) -> DataFrame:
    """The least path (by its node ids) of the fewest hops: ``distance``, ``nodes`` and ``relations``; no row if there is none.

    Of parallel edges the least type counts. The search ends at the hop that
    reaches the goal, or when nothing new is reached.
    """
    spark = edges.sparkSession
    doubled = both_ways(edges).groupBy("a", "b").agg(F.min("type").alias("type"))
    frontier = spark.createDataFrame([(start, [start], [])], "id string, nodes array<string>, relations array<string>")
    reached = frontier.select("id")
    for _ in range(most if start != goal else 0):
        step = frontier.join(doubled, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("relations", F.array("type")).alias("relations"))
        step = step.join(reached, "id", "left_anti").groupBy("id").agg(F.min(F.struct("nodes", "relations")).alias("p")).select("id", "p.nodes", "p.relations")
        frontier = cut(step)
        last = frontier.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.col("id") == goal), F.lit(False)).alias("found")).first()
        if last.found or not last.n:
            break
        reached = reached.unionByName(frontier.select("id"))
    return frontier.where(F.col("id") == goal).select((F.size("nodes") - 1).alias("distance"), "nodes", "relations")


def entity_path(edges: DataFrame, nodes: DataFrame, first: str, second: str, most: int = 5) -> DataFrame:
    """The shortest path between two entities given by name: ``distance``, ``path_nodes`` (names, null where a node has none), ``relations``.

    ``nodes`` has id, label and name. Of entities of one name the one with the least id is taken.
    """
    ends = nodes.where((F.col("label") == "Entity") & F.col("name").isin(first, second)).groupBy("name").agg(F.min("id").alias("id"))
    ids = {r.name: r.id for r in ends.collect()}  # two rows at most
    if first not in ids or second not in ids:
        return edges.sparkSession.createDataFrame([], "distance int, path_nodes array<string>, relations array<string>")
    path = shortest_path(edges, ids[first], ids[second], most)
    steps = path.select("distance", "relations", F.posexplode("nodes").alias("at", "id"))
    named = steps.join(nodes.select("id", F.col("name").alias("own")).dropDuplicates(["id"]), "id", "left")
    names = F.transform(F.sort_array(F.collect_list(F.struct("at", "own"))), lambda x: x["own"])
    return named.groupBy("distance", "relations").agg(names.alias("path_nodes")).select("distance", "path_nodes", "relations")


def entity_context(relations: DataFrame, name: str) -> DataFrame:
    """Neighbours of an entity: name, type of edge and direction."""
    out = relations.where(F.col("source") == name).select(F.col("target").alias("name"), "type", F.lit("out").alias("direction"))
    into = relations.where(F.col("target") == name).select(F.col("source").alias("name"), "type", F.lit("in").alias("direction"))
    return out.unionByName(into).distinct()


def entity_documents(mentions: DataFrame, chunks: DataFrame, documents: DataFrame, name: str) -> DataFrame:
    """Documents with a chunk that mentions the entity, by its types."""
    own = mentions.where(F.col("name") == name).select("type", "chunk_id").distinct().join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    return own.select("type", "doc_id").distinct().join(documents.select("doc_id", "title"), "doc_id").select("type", "doc_id", "title")


def subgraph(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 200, include_faq: bool = True, label: str | None = None, active: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, depth) around ``seeds`` (id) and the edges among them.

    ``nodes`` has id and label. The nearest ``limit`` nodes count, by depth, label
    and id; FAQs then go unless wanted. ``label`` restricts the seeds to one kind
    (document neighbourhoods). Inactive nodes count, unless ``active`` (id) lists those that may.
    """
    kinds = nodes.select("id", "label")
    seeds = cut(seeds.select("id").join(kinds if label is None else kinds.where(F.col("label") == label), "id", "left_semi"))
    reached = ball(edges, seeds, hops).join(kinds, "id").dropDuplicates(["id"])
    if active is not None:
        reached = reached.join(active.select("id"), "id", "left_semi")
    near = reached.orderBy("depth", "label", "id").limit(max(1, limit))
    kept = near if include_faq else near.where("label <> 'FAQ'")
    kept = cut(kept.select("id", "label", "depth"))
    return kept, induced(edges, kept)


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes, one of each."""
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.select("src", "type", "dst").distinct()


def as_records(nodes: DataFrame, edges: DataFrame, *own: str) -> tuple[DataFrame, DataFrame]:
    """Nodes as (id, labels, properties) and edges as (id, type, start, end, props), null values left out."""
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in own]), lambda e: e["v"].isNotNull())
    props = F.map_from_entries(entries) if own else F.create_map().cast("map<string,string>")
    made = nodes.where("id is not null").dropDuplicates(["id"]).select("id", F.array("label").alias("labels"), props.alias("properties"))
    return made, edges.select(F.concat_ws("|", "src", "type", "dst").alias("id"), "type", F.col("src").alias("start"), F.col("dst").alias("end"), F.create_map().cast("map<string,string>").alias("props")).dropDuplicates(["id"])


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, ties by the other columns; null keys go. Rows meet after each task kept its first, so a hub is no task."""
    others = [c for c in rows.columns if c != key and c not in order]
    least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *others)).alias("_first"))
    return least.select(*(F.col(c) if c == key else F.col(f"_first.{c}").alias(c) for c in rows.columns))
