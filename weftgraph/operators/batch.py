"""The hybrid chain for a table of questions at once: no driver step a question.

Questions are (qid, text). Terms of all questions meet the distinct names by a
common gram, vectors meet in blocks (``vector_index``), and what is ranked, fused
and cut is ranked, fused and cut by question. The graph is walked with (question,
node) frontiers over adjacency, of the reached nodes or stored, that has a node's
nearest neighbours in the order of the result, so a hub costs as much as the
result may show of it. Texts, vectors and edges meet what is asked where they are
read, as long as that is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..functions.vectors import hash_sums, hash_vectors
from ..storage import MOST_BROADCAST, cut, stored
from . import vector_index
from .answer import Tables
from .search import is_active
from .text_index import GRAM, gram_column


def asked(questions: DataFrame) -> DataFrame:
    """``qid``, ``term`` of all questions."""
    return questions.select("qid", F.explode(query_terms(F.col("text"))).alias("term")).distinct()


def _matches(terms: DataFrame, names: DataFrame) -> DataFrame:
    """``term`` and ``name`` (stored, each once) where the lower-cased name contains the term: they meet by the rarest gram of the term, of which a name has one."""
    low = F.lower("name")
    short = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.struct(F.substring(low, i, F.lit(1)).alias("a"), F.substring(low, i, F.lit(2)).alias("b")))
    pieces = F.array_distinct(F.concat(gram_column(low), F.transform(short, lambda x: x["a"]), F.transform(short, lambda x: x["b"])))
    posted = names.select("name", F.explode(pieces).alias("gram"))
    own = F.when(F.length("term") >= GRAM, gram_column(F.col("term"))).otherwise(F.array("term"))
    each = stored(terms.select("term").distinct().select("term", F.explode(own).alias("gram")), "term_grams")
    counts = posted.join(_few(each.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return posted.join(_few(stored(rarest, "rarest_grams")), "gram").where(F.contains(F.lower("name"), F.col("term"))).select("term", "name")


def _few(df: DataFrame) -> DataFrame:
    """A stored table that is broadcast where it is small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def named_seeds(t: Tables, terms: DataFrame, limit: int) -> DataFrame:
    """``qid``, ``chunk_id``, ``rank`` by names; only for questions without any by tags."""
    own, few = t.chunks.where(is_active()).select("chunk_id", "chunk_index"), _few(terms)

    def counted(rows: DataFrame, name: str, branch: int) -> DataFrame:
        found = _matches(terms, stored(rows.select(F.col(name).alias("name")).distinct(), "names"))
        hit = rows.select("chunk_id", F.col(name).alias("name")).join(found, "name").groupBy("chunk_id").agg(F.collect_set("term").alias("terms"))
        # Dealt by chunk, so the many (question, chunk) are counted and cut where they are made.
        each = hit.join(own, "chunk_id").select("chunk_id", "chunk_index", F.explode("terms").alias("term"))
        many = each.join(few, "term").groupBy("qid", "chunk_id", "chunk_index").agg(F.count(F.lit(1)).alias("match_count"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("match_count"), "chunk_index", "chunk_id"))
        return many.withColumn("rank", place).where(F.col("rank") <= limit).select("qid", "chunk_id", "rank", F.lit(branch).alias("branch"))

    both = counted(t.mentions, "name", 0).unionByName(counted(t.tags, "tag", 1))
    least = F.min("branch").over(Window.partitionBy("qid"))
    return both.withColumn("least", least).where("branch = least").select("qid", "chunk_id", "rank")


def vector_seeds(t: Tables, questions: DataFrame, dims: int, top_k: int, index: vector_index.VectorIndex | None = None, probes: int = 8) -> DataFrame:
    """``qid``, ``chunk_id``, ``rank``, ``vector_score``; inactive chunks go afterwards. With an index only its nearest cells are read."""
    if index is not None:
        near = vector_index.search(index, hash_vectors(questions, "qid", "text", dims), "qid", "vec", top_k, probes)
    elif "places" in t.vectors.columns:
        near = vector_index.nearest_sparse(hash_sums(questions, "qid", "text", dims), "qid", t.vectors, "chunk_id", dims, top_k)
    else:
        near = vector_index.nearest_each(hash_vectors(questions, "qid", "text", dims), "qid", "vec", t.vectors, "chunk_id", "embedding", dims, top_k)
    kept = near.join(t.chunks.where(is_active()).select(F.col("chunk_id").alias("key")), "key", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return kept.select(F.col("query").alias("qid"), F.col("key").alias("chunk_id"), rank.alias("rank"), F.col("score").alias("vector_score"))


def _min_max(value: str):
    every = Window.partitionBy("qid")
    low, high = F.min(value).over(every), F.max(value).over(every)
    flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(F.col(value).isNull(), None).when(flat, 1.0).otherwise((F.col(value) - low) / (high - low))


def fused(graph: DataFrame, vector: DataFrame, k: int = 60, bonus: float = 0.15) -> DataFrame:
    """Reciprocal-rank fusion by question."""
    best = vector.select("qid", "chunk_id", F.col("rank").alias("vector_rank"), "vector_score", _min_max("vector_score").alias("vector_norm"))
    both = graph.select("qid", "chunk_id", F.col("rank").alias("graph_rank")).join(best, ["qid", "chunk_id"], "full")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", part("graph_rank") + part("vector_rank")).withColumn("rrf_norm", _min_max("rrf"))
    norm = F.coalesce("vector_norm", F.lit(0.0))
    return both.select("qid", "chunk_id", F.col("graph_rank").isNotNull().alias("has_graph"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), norm.alias("vector_norm"), "rrf_norm", (F.col("rrf") + bonus * norm).alias("merge_score"))


def adjacency(edges: DataFrame, nodes: DataFrame, limit: int, of: DataFrame | None = None) -> DataFrame:
    """``a``, ``b``, ``label`` (of b): the first neighbours of each node (``of`` these, ``a``, only) by label and id, twice ``limit`` at most.

    The cut is made before the shuffle too, so a hub's edges never meet in a task.
    Edges that come again have the same place, so they go after the cut.
    """
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    ends = ends if of is None else ends.join(of, "a", "left_semi")
    known = ends.join(nodes.select(F.col("id").alias("b"), "label").distinct(), "b")
    place = F.dense_rank().over(Window.partitionBy("a").orderBy("label", "b"))
    return known.withColumn("place", place).where(F.col("place") <= 2 * limit).select("a", "b", "label").distinct()


def expanded(near: DataFrame | Callable[[DataFrame], DataFrame], nodes: DataFrame, seeds: DataFrame, hops: int, limit: int) -> DataFrame:
    """``qid``, ``id``, ``label``, ``depth`` of the nearest ``limit`` nodes of each question's seeds (qid, id), by depth, label and id.

    ``near`` is the ``adjacency``, or makes that of given nodes (``a``), a question's
    ``limit`` of them at most. A question that has its ``limit`` goes no further;
    one that goes on has fewer nodes than that, so the neighbours it lacks are
    among the first ``2 * limit`` of each of them. Nodes without a label are not
    walked through.
    """
    seen = cut(seeds.select("qid", "id").distinct().join(nodes.select("id", "label").dropDuplicates(["id"]), "id").select("qid", "id", "label", F.lit(0).alias("depth")))
    for hop in range(1, max(1, hops) + 1):
        short = seen.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < limit).select("qid")
        frontier = seen.where(F.col("depth") == hop - 1).join(short, "qid", "left_semi").select("qid", F.col("id").alias("a"))
        if callable(near):
            frontier = _few(cut(frontier))
            around = near(_few(cut(frontier.select("a").distinct())))
        else:
            around = near
        step = around.join(frontier, "a").select("qid", F.col("b").alias("id"), "label").distinct().join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
        place = F.row_number().over(Window.partitionBy("qid").orderBy("label", "id"))
        step = cut(step.withColumn("place", place).where(F.col("place") <= limit).select("qid", "id", "label", F.lit(hop).alias("depth")))
        if step.isEmpty():
            break
        seen = seen.unionByName(step)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("depth", "label", "id"))
    return seen.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def retrieve(t: Tables, questions: DataFrame, dims: int = 384, hops: int = 2, limit: int = 50, seed_limit: int = 8, top_k: int = 6, seeds_kept: int = 16, others_kept: int = 24, index: vector_index.VectorIndex | None = None, near: DataFrame | None = None) -> DataFrame:
    """Re-ranked chunks of each question: ``qid``, ``chunk_id``, ``is_seed``, ``retrieval_score``, ``place``.

    ``t.vectors`` are embeddings of ``dims`` dimensions by ``hash_embedding``, as are
    the questions'. A question without text has no seeds by name. ``near`` may
    give the stored ``adjacency`` for ``limit``; without it the edges are read once a
    hop, and those of the nodes that were reached are kept. ``t.vectors`` may have
    ``places`` and ``parts`` (``hash_sums``) instead of ``embedding``.
    """
    terms = stored(asked(questions), "terms")
    seeds = cut(fused(named_seeds(t, terms, seed_limit), vector_seeds(t, questions, dims, top_k, index)))
    near = (lambda of: adjacency(t.edges, t.nodes, limit, of)) if near is None else near
    nodes = expanded(near, t.nodes, seeds.select("qid", F.col("chunk_id").alias("id")), hops, limit)
    ids = nodes.where("label = 'Chunk'").select("qid", F.col("id").alias("chunk_id")).unionByName(seeds.select("qid", "chunk_id")).distinct()
    own = terms.groupBy("qid").agg(F.collect_list("term").alias("terms"))
    rows = ids.join(seeds.withColumn("is_seed", F.lit(True)), ["qid", "chunk_id"], "left").join(own, "qid", "left")
    rows = t.chunks.select("chunk_id", F.lower("text").alias("low")).join(_few(stored(rows, "ranked")), "chunk_id")
    share = F.size(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda x: F.contains("low", x))) / F.greatest(F.size(F.coalesce("terms", F.array().cast("array<string>"))), F.lit(1))
    is_seed = F.coalesce("is_seed", F.lit(False))
    graph = F.greatest(F.when(F.coalesce("has_graph", F.lit(False)), 1.0).otherwise(0.0), F.coalesce("rrf_norm", F.lit(0.0)))
    score = 0.55 * F.coalesce("vector_norm", F.lit(0.0)) + 0.25 * graph + 0.20 * share + F.when(is_seed, 0.10).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy("qid", "is_seed").orderBy(F.desc("retrieval_score"), F.desc("chunk_id")))
    ranked = rows.select("qid", "chunk_id", is_seed.alias("is_seed"), F.round(score, 6).alias("retrieval_score")).withColumn("place", place)
    return ranked.where(F.col("place") <= F.when(F.col("is_seed"), seeds_kept).otherwise(others_kept))
