"""What is shown of retrieved rows: context text, citations, and the path between a question's terms.

Chunks, documents and nodes are those that a search returned, so they are bounded by its limits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import traverse


def citations(seeds: DataFrame, documents: DataFrame, limit: int = 10) -> DataFrame:
    """The best seeds (chunk_id, doc_id, place, retrieval_score) with their titles; addresses are left out."""
    top = seeds.select("chunk_id", "doc_id", "place", "retrieval_score").orderBy("place", "chunk_id").limit(max(1, limit))
    return top.join(documents.select("doc_id", "title"), "doc_id", "left").select("doc_id", "chunk_id", F.coalesce("title", F.lit("")).alias("title"), F.lit(None).cast("string").alias("url"), F.col("retrieval_score").cast("double").alias("score"))


def _lines(rows: DataFrame, line: Column, order: Sequence[str], most: int, head: str, rank: int, joint: str) -> DataFrame:
    """One row: a section's text, or no row where it has no lines."""
    kept = rows.select(F.struct(*order).alias("k"), line.alias("line")).orderBy("k").limit(most)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda r: r["line"]), joint)
    return kept.agg(F.count(F.lit(1)).alias("n"), body.alias("body")).where("n > 0").select(F.lit(rank).alias("rank"), F.concat(F.lit(head + ":\n"), "body").alias("section"))


def render(documents: DataFrame, tags: DataFrame, entities: DataFrame, seeds: DataFrame, neighbours: DataFrame, faqs: DataFrame) -> DataFrame:
    """One row, ``context``: sections of documents (doc_id, title), tags (tag), entities (name, type), chunks
    (chunk_id, doc_id, text, place) and faqs (question, answer), empty ones left out."""

    def cut(c: Column, n: int) -> Column:
        return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)

    flat = F.replace(F.trim(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" "))
    chunk = F.concat(F.lit("- chunk_id="), "chunk_id", F.lit(" doc_id="), "doc_id", F.lit(" :: "), cut(flat, 800))
    whole = 2**31 - 1
    sections = [
        _lines(documents.distinct(), F.format_string("- %s (doc_id=%s)", F.coalesce("title", F.lit("")), "doc_id"), ["doc_id"], whole, "DOCUMENTS", 1, "\n"),
        _lines(tags.distinct(), F.col("tag"), ["tag"], 30, "TAGS", 2, ", "),
        _lines(entities.distinct(), F.format_string("%s[%s]", "name", "type"), ["name", "type"], 30, "ENTITIES", 3, ", "),
        _lines(seeds, chunk, ["place", "chunk_id"], 20, "SEED CHUNKS", 4, "\n"),
        _lines(neighbours, chunk, ["place", "chunk_id"], 20, "NEIGHBOR CHUNKS", 5, "\n"),
        _lines(faqs, F.concat(F.lit("- Q: "), F.trim(F.coalesce("question", F.lit(""))), F.lit("\n  A: "), cut(F.trim(F.coalesce("answer", F.lit(""))), 300)), ["question", "answer"], 10, "FAQ (linked)", 6, "\n"),
    ]
    every = sections[0]
    for s in sections[1:]:
        every = every.unionByName(s)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "section"))), lambda r: r["section"]), "\n\n")
    return every.agg(text.alias("t")).select(F.when(F.col("t") == "", "No graph context found.").otherwise(F.col("t")).alias("context"))


def merge(context: Column, more: Column, most: int = 2200) -> Column:
    """Context with outside text after it, which is cut to ``most`` (200 at least)."""
    extra, most = F.trim(F.coalesce(more, F.lit(""))), max(200, most)
    cut = F.when(F.length(extra) > most, F.concat(F.substring(extra, 1, most - 3), F.lit("..."))).otherwise(extra)
    return F.when(extra == "", context).otherwise(F.concat(context, F.lit("\n\nEXTERNAL TOOL CONTEXT:\n"), cut))


def keyword_nodes(nodes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The best node (id, label, name) of each term (term, id, name): equal names before names that contain the
    term, entities before tags, then the shortest and least name. Terms without one give no row."""
    asked = F.explode(F.array(*[F.lit(t.strip().lower()) for t in dict.fromkeys(terms)]).cast("array<string>")).alias("term")
    low = F.lower("name")
    hits = nodes.where(F.col("label").isin("Entity", "Tag")).select("id", "label", "name", asked).where((F.col("term") != "") & F.contains(low, F.col("term")))
    key = F.struct((low != F.col("term")).alias("inside"), (F.col("label") != "Entity").alias("tag"), F.length("name").alias("n"), low.alias("low"), F.col("id").alias("id"), F.col("name").alias("name"))
    return hits.groupBy("term").agg(F.min(key).alias("k")).select("term", "k.id", "k.name")


def keyword_path(nodes: DataFrame, edges: DataFrame, terms: Sequence[str], most: int = 5) -> tuple[list[str], list[str]]:
    """Names of the entities and tags on the way from each term's node to the next one's, and the terms without a node.

    No names if a part of the way takes more than ``most`` hops. The way's ids (terms x hops at most) come to the driver.
    """
    found = {r.term: r for r in keyword_nodes(nodes, terms).collect()}
    missing = [t for t in terms if t.strip().lower() not in found]
    stops = [found[t.strip().lower()] for t in terms if t.strip().lower() in found]
    if len(terms) == 1 and stops:
        return [stops[0].name], missing
    if len(stops) < 2:
        return [], missing
    way = [stops[0].id]
    for stop in stops[1:]:
        part = traverse.shortest_path(edges, way[-1], stop.id, most).first()
        if part is None:
            return [], missing
        way += part.nodes[1:]
    names = {r.id: r.name for r in nodes.where(F.col("id").isin(way) & F.col("label").isin("Entity", "Tag") & F.col("name").isNotNull()).select("id", "name").collect()}
    out: list[str] = []
    for n in way:
        if n in names and (not out or out[-1].lower() != names[n].lower()):
            out.append(names[n])
    return out, missing
