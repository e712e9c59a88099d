"""Fusion of ranked lists and re-ranking. Lists are top-k tables: small by their limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max(value: str) -> Column:
    """Scaled to 0..1 over all rows; 1 where all are equal."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low, high = F.min(value).over(every), F.max(value).over(every)
    flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(F.col(value).isNull(), None).when(flat, 1.0).otherwise((F.col(value) - low) / (high - low))


def fuse(graph: DataFrame, vector: DataFrame, k: int = 60, bonus: float = 0.15) -> DataFrame:
    """Reciprocal-rank fusion of ``graph`` (chunk_id, rank) and ``vector`` (chunk_id, rank, vector_score)."""
    best = vector.groupBy("chunk_id").agg(F.min("rank").alias("vector_rank"), F.max("vector_score").alias("vector_score"))
    best = best.withColumn("vector_norm", min_max("vector_score"))
    both = graph.groupBy("chunk_id").agg(F.min("rank").alias("graph_rank")).join(best, "chunk_id", "full")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", part("graph_rank") + part("vector_rank")).withColumn("rrf_norm", min_max("rrf"))
    both = both.withColumn("merge_score", F.col("rrf") + bonus * F.coalesce("vector_norm", F.lit(0.0)))
    both = both.withColumn("has_graph", F.col("graph_rank").isNotNull())
    return both.select("chunk_id", "has_graph", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("vector_norm", F.lit(0.0)).alias("vector_norm"), "rrf_norm", "merge_score")


def best_first() -> tuple[Column, ...]:
    """The order of fused rows; it is total."""
    return F.desc("merge_score"), F.desc("vector_score"), F.desc("has_graph"), F.desc("chunk_id")


def rerank(rows: DataFrame, terms: list[str], seed_limit: int = 16, neighbour_limit: int = 24) -> DataFrame:
    """Weighs vector, graph, term and seed evidence; the best of seeds and of neighbours."""
    share = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("text"), t))) / max(1, len(terms))
    graph = F.greatest(F.when(F.col("has_graph"), 1.0).otherwise(0.0), F.coalesce("rrf_norm", F.lit(0.0)))
    score = 0.55 * F.coalesce("vector_norm", F.lit(0.0)) + 0.25 * graph + 0.20 * share + F.when(F.col("is_seed"), 0.10).otherwise(0.0)
    scored = rows.withColumn("retrieval_score", F.round(score, 6))
    order = (F.desc("retrieval_score"), F.desc("chunk_id"))
    best = scored.where("is_seed").orderBy(*order).limit(seed_limit).unionByName(scored.where(~F.coalesce("is_seed", F.lit(False))).orderBy(*order).limit(neighbour_limit))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("is_seed").orderBy(*order)))
