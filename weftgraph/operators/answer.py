"""The hybrid chain: seeds, vector seeds, fusion, expansion, enrichment, re-ranking, context and answer.

Only seeds (by their limits) are numbered in one task; the graph is walked by
joins, and what comes to the driver is the text of a context.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from . import context, hybrid, search, traverse


@dataclass(frozen=True)
class Tables:
    """A graph: documents, chunks, mentions, tags, vectors (chunk_id, embedding), nodes (id, label, name, type, question, answer), edges."""

    documents: DataFrame
    chunks: DataFrame
    mentions: DataFrame
    tags: DataFrame
    vectors: DataFrame
    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Retrieved:
    """What a question found. ``chunks`` has is_seed, place and retrieval_score; ``edges`` only after a whole ``retrieve``."""

    seeds: DataFrame
    nodes: DataFrame
    edges: DataFrame | None
    chunks: DataFrame
    documents: DataFrame
    tags: DataFrame
    entities: DataFrame
    faqs: DataFrame


class Client(Protocol):
    """What answers from a context. One that fails for a context too long raises ``TooLong``."""

    def generate_answer(self, question: str, context: str) -> str: ...


class TooLong(Exception):
    pass


class Extract:
    """Answers with the context itself: no model."""

    def generate_answer(self, question: str, context: str) -> str:
        return f"{question.strip()}\n\n{context}"


#: Lengths that a context too long is cut to, one after the other, and what stands for what is left out.
CUTS = (8000, 5000, 3000, 1800)
CUT_MARK = "\n...[context truncated due model limits]..."
NO_CONTEXT = "Context omitted because model rejected oversized prompt."


def generate(client: Client, question: str, text: str) -> str:
    """An answer; a context that is too long is cut shorter and shorter, and at last left out."""
    for tried in [text, *(text[:n] + CUT_MARK for n in CUTS if len(text) > n)]:
        try:
            return client.generate_answer(question, tried)
        except TooLong:
            continue
    return client.generate_answer(question, NO_CONTEXT)


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Ranks of a list that a limit has made short."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def merged_seeds(t: Tables, terms: Sequence[str], query: list[float] | None, seed_limit: int = 8, top_k: int = 6) -> DataFrame:
    """Seeds by names and tags fused with those by vector, best first as ``rank``. No vector, or an empty one: names only."""
    named = _numbered(search.seeds(t.chunks, t.mentions, t.tags, list(terms), seed_limit), F.desc("match_count"), "chunk_index", "chunk_id").select("chunk_id", "rank")
    if query:
        near = search.vector_search(t.vectors, t.chunks, t.documents, query, top_k)
        near = _numbered(near, F.desc("score"), "chunk_id").select("chunk_id", "rank", F.col("score").alias("vector_score"))
    else:
        near = named.sparkSession.createDataFrame([], "chunk_id string, rank int, vector_score double")
    fused = hybrid.fuse(named, near)
    return _numbered(fused, *hybrid.best_first())


def retrieve(t: Tables, terms: Sequence[str], query: list[float] | None, hops: int = 2, limit: int = 50, seed_limit: int = 8, top_k: int = 6) -> Retrieved:
    """The whole chain but the text."""
    seeds = cut(merged_seeds(t, terms, query, seed_limit, top_k))
    nodes, edges = traverse.subgraph(t.edges, t.nodes, seeds.select(F.col("chunk_id").alias("id")), hops, limit)
    details = enrich(t, nodes, seeds)
    rows = details.chunks.join(F.broadcast(seeds.select("chunk_id", "has_graph", "vector_norm", "rrf_norm")), "chunk_id", "left")
    rows = cut(rows.withColumn("has_graph", F.coalesce("has_graph", F.lit(False))))  # few, and read twice
    ranked = hybrid.rerank(rows, list(terms))
    return replace(details, seeds=seeds, edges=edges, chunks=ranked.drop("has_graph", "vector_norm", "rrf_norm"))


def enrich(t: Tables, nodes: DataFrame, seeds: DataFrame) -> Retrieved:
    """Chunks, documents, tags, entities and FAQs of the nodes that were reached; seeds that were not are chunks too."""
    ids = nodes.where("label = 'Chunk'").select(F.col("id").alias("chunk_id")).unionByName(seeds.select("chunk_id")).distinct()
    own = t.chunks.select("chunk_id", "doc_id", "chunk_index", "text").join(F.broadcast(ids), "chunk_id", "left_semi")
    own = own.join(F.broadcast(seeds.select("chunk_id", F.lit(True).alias("is_seed"))), "chunk_id", "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    chunks = own.join(t.documents.select("doc_id", "title"), "doc_id", "left")
    full = t.nodes.drop("label").join(F.broadcast(nodes.select("id", "label")), "id")
    return Retrieved(
        seeds=seeds,
        nodes=nodes,
        edges=None,
        chunks=chunks,
        documents=chunks.where("doc_id is not null").select("doc_id", F.coalesce("title", F.lit("")).alias("title")).distinct(),
        tags=full.where("label = 'Tag' and name <> ''").select(F.col("name").alias("tag")).distinct(),
        entities=full.where("label = 'Entity' and name <> ''").select("name", F.coalesce("type", F.lit("")).alias("type")).distinct(),
        faqs=full.where("label = 'FAQ'").select(F.col("id").alias("faq_id"), "question", "answer").dropDuplicates(["faq_id"]),
    )


def rendered(found: Retrieved) -> str:
    part = lambda seed: found.chunks.where(F.col("is_seed") == seed)
    return context.render(found.documents, found.tags, found.entities, part(True), part(False), found.faqs).first().context


def answer(t: Tables, question: str, terms: Sequence[str], query: list[float] | None = None, client: Client | None = None, more: str = "", trace: bool = False, **limits) -> dict:
    """The answer with its citations and, if wanted, the counts of what it rests on."""
    found = retrieve(t, terms, query, **limits)
    text = rendered(found)
    if more.strip():
        text = found.seeds.sparkSession.range(1).select(context.merge(F.lit(text), F.lit(more)).alias("x")).first().x
    out = {"answer": generate(client or Extract(), question, text), "citations": [r.asDict() for r in context.citations(found.chunks.where("is_seed"), t.documents).collect()]}
    if trace:
        kinds = {r.label: r["count"] for r in found.nodes.groupBy("label").count().collect()}
        out["trace"] = {"terms": list(terms), "seeds": [r.chunk_id for r in found.seeds.orderBy("rank").collect()], "nodes": kinds, "edges": found.edges.count(), "context": text}
    return out
