"""Lexical, vector and seed retrieval over chunks.

A graph is given by tables: chunks (chunk_id, doc_id, chunk_index, text,
active), documents (doc_id, title, source_type, active), mentions (chunk_id,
name, type) and tags (chunk_id, tag). Null ``active`` counts as true.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..functions.vectors import cosine, euclidean


def is_active(column: str = "active") -> Column:
    return F.coalesce(F.col(column), F.lit(True))


def terms_of(spark: SparkSession, query: str) -> list[str]:
    """A query's terms, worked out once and not for each row."""
    return list(spark.range(1).select(query_terms(F.lit(query)).alias("t")).first().t)


def _hits(rows: DataFrame, name: str, terms: list[str], out: str) -> DataFrame:
    """How many terms a chunk's names contain or lie in: only chunks that have some."""
    low = F.lower(name)
    some = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)) | F.contains(F.lit(t), low), F.lit(t)) for t in terms]))
    hit = rows.select("chunk_id", F.explode(some).alias("term"))
    return hit.groupBy("chunk_id").agg(F.size(F.collect_set("term")).alias(out))


def lexical_search(chunks: DataFrame, documents: DataFrame, mentions: DataFrame, tags: DataFrame, query: str, limit: int = 12, compat: bool = False, with_url: bool = False) -> DataFrame:
    """Top chunks by 3 x terms in the text + 2 x terms in entities + terms in tags.

    Names are matched where they are, and what is joined to the chunks are
    counts of the chunks that have a hit. With ``compat`` a chunk without
    entities or tags has the empty name, which every term contains. A query
    without a word gives nothing. ``with_url`` adds the document's address.
    """
    terms = terms_of(chunks.sparkSession, query)
    found = chunks.where(is_active()).select("chunk_id", "doc_id", "chunk_index", "text")
    for rows, name, out in ((mentions, "name", "entity_hits"), (tags, "tag", "tag_hits")):
        found = found.join(_hits(rows, name, terms, out), "chunk_id", "left") if terms else found.withColumn(out, F.lit(0))
        if compat:
            some = rows.select("chunk_id").distinct().withColumn("_named", F.lit(True))
            found = found.join(some, "chunk_id", "left").withColumn(out, F.when(F.col("_named"), F.col(out)).otherwise(F.lit(len(terms)))).drop("_named")
    in_text = sum((F.contains(F.lower("text"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    score = 3 * in_text + 2 * F.coalesce("entity_hits", F.lit(0)) + F.coalesce("tag_hits", F.lit(0))
    top = found.withColumn("score", score.cast("double")).where("score > 0").orderBy(F.desc("score"), "chunk_index", "chunk_id").limit(max(1, limit))
    more = ["url"] if with_url else []
    return top.join(documents.select("doc_id", "title", *more), "doc_id", "left").select("chunk_id", "text", "doc_id", "title", *more, "chunk_index", "score")


def check_index(dims: int, similarity: str = "cosine", name: str = "chunk_embedding_index") -> dict:
    """What a vector index is recorded by; unfit settings raise."""
    if dims <= 0 or similarity not in ("cosine", "euclidean") or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError("needs dimensions above 0, cosine or euclidean, and a plain name")
    return {"name": name, "dimensions": dims, "similarity": similarity}


def vector_search(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, query: list[float], top_k: int = 8, with_url: bool = False) -> DataFrame:
    """The nearest chunks of ``vectors`` (chunk_id, embedding), of which inactive ones then go: there may be fewer than ``top_k``."""
    near = nearest(vectors, "chunk_id", "embedding", query, top_k).select("chunk_id", "score")
    own = chunks.where(is_active()).select("chunk_id", "doc_id", "chunk_index", "text")
    more = ["url"] if with_url else []
    rows = F.broadcast(near).join(own, "chunk_id").join(documents.select("doc_id", "title", *more), "doc_id", "left")
    return rows.select("chunk_id", "text", "doc_id", "title", *more, "score").orderBy(F.desc("score"), "chunk_id")


def unembedded(chunks: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Chunks that have no vector of this model yet."""
    done = embedded.where(F.col("embedding").isNotNull() & (F.col("embedding_model") == model)).select("chunk_id")
    return chunks.join(done, "chunk_id", "left_anti")


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], top_k: int = 8, metric: str = "cosine") -> DataFrame:
    """Exact nearest neighbours, best first; ties by key. For euclidean the score is 1 / (1 + distance)."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    q = F.array(*[F.lit(float(x)) for x in query])
    score = cosine(F.col(vector), q) if metric == "cosine" else 1 / (1 + euclidean(F.col(vector), q))
    return vectors.select("*", score.alias("score")).orderBy(F.desc("score"), key).limit(max(1, top_k))


def seeds(chunks: DataFrame, mentions: DataFrame, tags: DataFrame, terms: list[str], limit: int = 8) -> DataFrame:
    """Chunks whose entities contain terms; only if there are none, those whose tags do."""
    wanted = F.array(*map(F.lit, terms))
    counted = lambda rows, name: rows.select("chunk_id", F.filter(wanted, lambda t: F.contains(F.lower(name), t)).alias("hit")).select("chunk_id", F.explode("hit").alias("term")).groupBy("chunk_id").agg(F.count_distinct("term").alias("match_count"))
    own = chunks.where(is_active()).select("chunk_id", "chunk_index")
    by_entity = counted(mentions, "name").withColumn("branch", F.lit(0))
    by_tag = counted(tags, "tag").withColumn("branch", F.lit(1))
    both = by_entity.unionByName(by_tag).join(own, "chunk_id")
    branch = both.agg(F.min("branch").alias("least"))
    return both.join(F.broadcast(branch), F.col("branch") == F.col("least")).orderBy(F.desc("match_count"), "chunk_index", "chunk_id").limit(max(1, limit)).select("chunk_id", "chunk_index", "match_count", "branch")
