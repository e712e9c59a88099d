"""Documents and keywords: listing, search and relatedness.

documents (doc_id, title, ...) and keywords (doc_id, keyword).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import keyword_pairs


def normalised(records: DataFrame) -> DataFrame:
    """Records (title, file_path, description, keywords) for ingest: clean keywords, titles from the file's name.

    All records are checked first: one without a file path fails the whole ingest.
    """
    path = F.trim(F.coalesce("file_path", F.lit("")))
    checked = F.when(path == "", F.raise_error(F.lit("a record needs a file_path"))).otherwise(path)
    name = F.element_at(F.split(path, "/"), -1)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), name)
    own = text.keywords(F.coalesce("keywords", F.array().cast("array<string>")))
    return records.select(checked.cast("string").alias("file_path"), title.alias("title"), F.coalesce("description", F.lit("")).alias("description"), name.alias("file_name"), own.alias("keywords"))


def _listed(documents: DataFrame, keywords: DataFrame, limit: int) -> DataFrame:
    top = documents.orderBy("title", "doc_id").limit(max(1, limit))
    own = keywords.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("keyword")), "|").alias("keywords"))
    return top.join(own, "doc_id", "left").select("doc_id", "title", F.coalesce("keywords", F.lit("")).alias("keywords"))


def list_documents(documents: DataFrame, keywords: DataFrame, limit: int = 50) -> DataFrame:
    return _listed(documents, keywords, limit)


def document_by_key(documents: DataFrame, keywords: DataFrame, doc_id) -> DataFrame:
    return _listed(documents.where(F.col("doc_id") == doc_id), keywords, 1)


def by_keywords(documents: DataFrame, keywords: DataFrame, wanted: Sequence[str], mode: str = "any", limit: int = 50) -> DataFrame:
    """Documents that have any, or all, of the keywords (trimmed, in lower case)."""
    names = list(dict.fromkeys(k.strip().lower() for k in wanted if k.strip()))
    if not names or mode not in ("any", "all"):
        raise ValueError("needs keywords, and mode any or all")
    hits = keywords.where(F.col("keyword").isin(names)).groupBy("doc_id").agg(F.count_distinct("keyword").alias("n"))
    return _listed(documents.join(hits.where(F.col("n") >= (len(names) if mode == "all" else 1)), "doc_id", "left_semi"), keywords, limit)


def by_title(documents: DataFrame, keywords: DataFrame, part: str, limit: int = 50) -> DataFrame:
    return _listed(documents.where(F.contains(F.lower("title"), F.lit(part.lower()))), keywords, limit)


def similarity_edges(keywords: DataFrame, least: int = 1) -> DataFrame:
    """Pairs a < b with their number of common keywords, ``least`` or more; null keywords match nothing.

    Documents are dealt into blocks, each two of which meet in a task that streams
    its pairs (``keyword_pairs``): no pair is shuffled.
    """
    return keyword_pairs.pairs(keywords, least)


def edges_of(keywords: DataFrame, doc_id, least: int = 1) -> DataFrame:
    """The similarity edges of one document: (doc_id, common_keywords) of the others. Only its own keywords are joined."""
    mine = keywords.where(F.col("doc_id") == doc_id).select("keyword").distinct()
    met = keywords.where(F.col("doc_id") != doc_id).join(mine, "keyword", "left_semi")
    return met.groupBy("doc_id").agg(F.count_distinct("keyword").alias("common_keywords")).where(F.col("common_keywords") >= least)


def similar(keywords: DataFrame, documents: DataFrame, doc_id, limit: int = 10, least: int = 1) -> DataFrame:
    top = edges_of(keywords, doc_id, least).join(documents.select("doc_id", "title"), "doc_id")
    return top.orderBy(F.desc("common_keywords"), "title", "doc_id").limit(max(1, limit)).select("doc_id", "title", "common_keywords")


def related(keywords: DataFrame, documents: DataFrame, doc_id, limit: int = 10, least: int = 1, edges: DataFrame | None = None) -> DataFrame:
    """Neighbours by 10 x the edge's count + keywords shared now.

    ``edges`` (a, b, common_keywords) are those of an earlier time, of parallel
    ones the strongest counts; without them the edges of now.
    """
    shared = edges_of(keywords, doc_id).withColumnRenamed("common_keywords", "shared")
    near = edges_of(keywords, doc_id, least)
    if edges is not None:
        ends = edges.where((F.col("a") == doc_id) | (F.col("b") == doc_id)).select(F.when(F.col("a") == doc_id, F.col("b")).otherwise(F.col("a")).alias("doc_id"), "common_keywords")
        near = ends.groupBy("doc_id").agg(F.coalesce(F.max("common_keywords"), F.lit(0)).alias("common_keywords"))
    score = 10 * F.coalesce("common_keywords", F.lit(0)) + F.coalesce("shared", F.lit(0))
    rows = near.join(shared, "doc_id", "left").join(documents.select("doc_id", "title"), "doc_id").select("doc_id", "title", score.alias("relevance"))
    return rows.orderBy(F.desc("relevance"), "title", "doc_id").limit(max(1, limit))


def by_entity(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, name: str, limit: int = 10) -> DataFrame:
    own = mentions.where(F.lower("name") == name.lower()).select("chunk_id").distinct().join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    counts = own.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("chunks_count"))
    return counts.join(documents.select("doc_id", "title"), "doc_id").orderBy(F.desc("chunks_count"), "title", "doc_id").limit(max(1, limit)).select("doc_id", "title", "chunks_count")


def by_topic(documents: DataFrame, chunks: DataFrame, tags: DataFrame, topic: str, limit: int = 10, compat: bool = False) -> DataFrame:
    """Documents whose title, text or a chunk's tag contains the topic, whatever its case.

    With ``compat`` the topic narrows what is matched beside a document, not the documents: all are listed.
    """
    if compat:
        return documents.select("doc_id", "title").distinct().orderBy("title", "doc_id").limit(max(1, limit))
    part = F.lit(topic.strip().lower())
    tagged = tags.where(F.contains(F.lower("tag"), part)).join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("doc_id").distinct().withColumn("tagged", F.lit(True))
    own = F.contains(F.lower("title"), part) | F.contains(F.lower("text"), part)
    return documents.join(tagged, "doc_id", "left").where(F.coalesce("tagged", F.lit(False)) | F.coalesce(own, F.lit(False))).orderBy("title", "doc_id").limit(max(1, limit)).select("doc_id", "title")


def topic_matches(documents: DataFrame, chunks: DataFrame, tags: DataFrame, topic: str) -> DataFrame:
    """Every document with its chunks and how many (chunk, tag) pairs the topic matches, by title, chunk text or tag.

    The topic is a predicate of the outer join: it narrows the tags that are met,
    not the documents, so those without a match are listed with 0. Texts are
    looked at where they are scanned; only the outcome is shuffled.
    """
    part = F.lit(topic.strip().lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), part), F.lit(False))
    own = documents.select("doc_id", "title", has("title").alias("by_title")).alias("d")
    held = chunks.select("doc_id", "chunk_id", has("text").alias("by_text")).alias("c")
    tagged = tags.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("tags"), F.count_if(has("tag")).alias("named")).alias("t")
    met = own.join(held, F.col("d.doc_id") == F.col("c.doc_id"), "left").join(tagged, F.col("c.chunk_id") == F.col("t.chunk_id"), "left")
    pairs = F.when(F.col("by_title") | F.col("by_text"), F.col("tags")).otherwise(F.col("named"))
    return met.groupBy("d.doc_id", "d.title").agg(F.count_distinct("c.chunk_id").alias("n_chunks"), F.coalesce(F.sum(pairs), F.lit(0)).alias("n_matches"))
