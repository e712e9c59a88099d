"""Writes as pure functions (existing, incoming, as_of) -> table; callers write a new version.

Tables: documents (doc_id), chunks (chunk_id, doc_id), tags (name), entities
(name, type), faqs (faq_id), edges (src, type, dst), relations (source,
source_type, type, target, target_type, props). Of incoming rows with one key
one counts: the last by a given order, else the greatest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def last_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def one_of_each(rows: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    if order is not None:
        return last_of_each(rows, keys, order)
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, *(f"_r.{c}" for c in rest))


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], as_of: str, order: str | None = None) -> DataFrame:
    """Full outer join by key; incoming values win where they aren't null. New rows get created_at, changed ones updated_at."""
    incoming = one_of_each(incoming, keys, order)
    names = [c for c in incoming.columns if c not in keys]
    now = F.lit(as_of).cast("timestamp")
    new = incoming.select(*keys, F.lit(True).alias("_in"), *[F.col(c).alias(f"_{c}") for c in names])
    both = existing.withColumn("_old", F.lit(True)).join(new, list(keys), "full")
    out = []
    for c in existing.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in names:
            out.append(F.coalesce(f"_{c}", c).alias(c))
        elif c == "created_at":
            out.append(F.coalesce(c, F.when(F.col("_in") & F.col("_old").isNull(), now)).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("_in"), now).otherwise(F.col(c)).alias(c))
        elif c == "active":
            out.append(F.when(F.col("_in"), F.lit(True)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def upsert_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One edge per (src, type, dst)."""
    return existing.select("src", "type", "dst").unionByName(incoming.select("src", "type", "dst")).where("src is not null and dst is not null").distinct()


def upsert_chunks(documents: DataFrame, chunks: DataFrame, edges: DataFrame, incoming: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of documents that exist, and their CONTAINS edges; others are left out."""
    own = incoming.join(documents.select("doc_id"), "doc_id", "left_semi")
    links = own.select(F.col("doc_id").alias("src"), F.lit("CONTAINS").alias("type"), F.col("chunk_id").alias("dst"))
    return upsert(chunks, own, ["chunk_id"], as_of), upsert_edges(edges, links)


def upsert_embeddings(chunks: DataFrame, incoming: DataFrame, model: str, as_of: str) -> DataFrame:
    """Chunks with the vectors of ``incoming`` (chunk_id, embedding): only of chunks that exist; empty vectors change nothing."""
    new = incoming.where(F.size("embedding") > 0).groupBy("chunk_id").agg(F.max("embedding").alias("_new"))
    both = chunks.join(new, "chunk_id", "left")
    pick = lambda value, c: F.when(F.col("_new").isNotNull(), value).otherwise(F.col(c)).alias(c)
    now = F.lit(as_of).cast("timestamp")
    changed = {"embedding": F.col("_new"), "embedding_model": F.lit(model), "embedding_dim": F.size("_new"), "embedding_updated_at": now, "updated_at": now}
    return both.select(*[pick(changed[c], c) if c in changed else F.col(c) for c in chunks.columns])


def upsert_tags(tags: DataFrame, edges: DataFrame, incoming: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags of ``incoming`` (owner, tag) in normal form and their HAS_TAG edges from owners (id) that exist."""
    own = incoming.select("owner", tx.tag(F.col("tag")).alias("name")).where("name is not null").join(owners.select(F.col("id").alias("owner")), "owner", "left_semi")
    links = own.select(F.col("owner").alias("src"), F.lit("HAS_TAG").alias("type"), F.concat(F.lit("t:"), "name").alias("dst"))
    return tags.select("name").unionByName(own.select("name")).distinct(), upsert_edges(edges, links)


def entity_id(name: str = "name", kind: str = "type"):
    return F.concat(F.lit("e:"), F.col(kind), F.lit("|"), F.col(name))


def upsert_entities(entities: DataFrame, edges: DataFrame, incoming: DataFrame, owners: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Entities of ``incoming`` (owner, name, type) and their MENTIONS edges from owners (id) that exist; nameless ones go."""
    own = incoming.select("owner", F.trim("name").alias("name"), tx.entity_type(F.col("type")).alias("type")).where("name <> ''").join(owners.select(F.col("id").alias("owner")), "owner", "left_semi")
    links = own.select(F.col("owner").alias("src"), F.lit("MENTIONS").alias("type"), entity_id().alias("dst"))
    return upsert(entities, own.select("name", "type"), ["name", "type"], as_of), upsert_edges(edges, links)


def upsert_relationships(entities: DataFrame, relations: DataFrame, incoming: DataFrame, as_of: str, allowed: Sequence[str] = tuple(tx.RELATION_TYPES)) -> tuple[DataFrame, DataFrame]:
    """Edges between entities from maps (``raw``): ends that are missing are made, one edge per ends and type, properties overlay."""
    rows = incoming.select(tx.relationship(F.col("raw"), list(allowed)).alias("r")).where("r is not null").select("r.*")
    ends = rows.select(F.col("source").alias("name"), F.col("source_type").alias("type")).unionByName(rows.select(F.col("target").alias("name"), F.col("target_type").alias("type"))).distinct()
    keys = ["source", "source_type", "type", "target", "target_type"]
    # Maps can't be ordered: of rows of one key the properties of the greatest entries win.
    listed = rows.withColumn("props", F.sort_array(F.map_entries("props"))).groupBy(*keys).agg(F.sort_array(F.collect_set("props")).alias("all"))
    overlay = F.aggregate(F.flatten("all"), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    new = listed.select(*keys, overlay.alias("_new"))
    both = relations.withColumn("_old", F.lit(True)).join(new, keys, "full")
    none = F.create_map().cast("map<string,string>")
    old, add = F.coalesce("props", none), F.coalesce("_new", none)
    props = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(add, k)), add)
    updated = F.when(F.col("_new").isNotNull(), F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))
    return upsert(entities, ends, ["name", "type"], as_of), both.select(*keys, props.alias("props"), updated.alias("updated_at"))


def link_refs(documents: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """REFERS_TO edges (src, dst) between documents that exist."""
    ids = documents.select(F.col("doc_id").alias("id"))
    known = refs.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    return upsert_edges(edges, known.select("src", F.lit("REFERS_TO").alias("type"), "dst"))


def link_similarities(nodes: DataFrame, similar: DataFrame, incoming: DataFrame, label: str, as_of: str) -> DataFrame:
    """SIMILAR_TO edges (src, dst, score) between nodes (id, label) of one label that exist."""
    if label not in ("Chunk", "FAQ", "Document"):
        raise ValueError(f"no similarities between {label!r}")
    ids = nodes.where(F.col("label") == label).select("id")
    known = incoming.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    return upsert(similar, known.select("src", "dst", F.col("score").cast("double").alias("score")), ["src", "dst"], as_of)


def link_faqs(faqs: DataFrame, chunks: DataFrame, edges: DataFrame, derived: DataFrame) -> DataFrame:
    """DERIVED_FROM edges (faq_id, chunk_id) from FAQs that exist to chunks that exist."""
    known = derived.join(faqs.select("faq_id"), "faq_id", "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return upsert_edges(edges, known.select(F.col("faq_id").alias("src"), F.lit("DERIVED_FROM").alias("type"), F.col("chunk_id").alias("dst")))


def link_faq_parts(faqs: DataFrame, chunks: DataFrame, tags: DataFrame, entities: DataFrame, edges: DataFrame, parts: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tags, entities and edges after FAQs are linked with what ``parts`` says: (faq_id, chunk_ids, tags, entities as (name, type)).

    Chunks have to exist, tags and entities are made where they don't; an FAQ that
    doesn't exist gets no link. Null lists are empty.
    """
    owners = faqs.select(F.col("faq_id").alias("id"))
    each = lambda column, name: parts.select(F.col("faq_id").alias("owner"), F.explode(column).alias(name))
    edges = link_faqs(faqs, chunks, edges, each("chunk_ids", "chunk_id").withColumnRenamed("owner", "faq_id"))
    tags, edges = upsert_tags(tags, edges, each("tags", "tag"), owners)
    entities, edges = upsert_entities(entities, edges, each("entities", "e").select("owner", "e.name", "e.type"), owners, as_of)
    return tags, entities, edges


#: The key of each table.
KEYS = {"documents": ["doc_id"], "chunks": ["chunk_id"], "faqs": ["faq_id"], "tags": ["name"], "entities": ["name", "type"]}


def doubled_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, or are null: none if the table keeps its constraint."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False)))


def cleared(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without rows; their schemas and keys stay."""
    return {name: t.limit(0) for name, t in tables.items()}


def soft_delete(documents: DataFrame, chunks: DataFrame, faqs: DataFrame, derived: DataFrame, doc_id) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inactive: the document, its chunks, and FAQs derived from any of them."""
    gone = chunks.where(F.col("doc_id") == doc_id).select("chunk_id")
    faq_ids = derived.join(gone, "chunk_id", "left_semi").select("faq_id").distinct().withColumn("_gone", F.lit(True))
    off = lambda df: df.withColumn("active", F.when(F.col("doc_id") == doc_id, F.lit(False)).otherwise(F.col("active")))
    marked = faqs.join(faq_ids, "faq_id", "left").withColumn("active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("active"))).drop("_gone")
    return off(documents), off(chunks), marked
