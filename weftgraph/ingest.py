"""From a manifest to a graph in one set-wise plan: texts, chunks, annotations (cached), writes.

Only the annotator leaves the JVM, and only for chunks that the cache doesn't
hold. ``Words`` annotates without a model; others implement ``Annotator`` and
are sent to the executors.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.values import json_array, json_object
from .operators import phrases, writes
from .sources import ANNOTATION, read_annotation, settings_key
from .storage import load_version, save_version, stored

CACHE = "key string, text_hash string, settings string, chunk_index int, chunk_hash string, annotation string, updated_at long"
#: Most entities, relations, questions and keywords of a chunk, and texts that are embedded at a time.
MOST = {"entities": 12, "relationships": 10, "candidate_qas": 3, "tags": 12}
BATCH = 16


class Annotator(Protocol):
    """Annotates chunk texts, as dictionaries with the fields of ``ANNOTATION``."""

    def annotate(self, texts: list[str]) -> list[dict]: ...


class Embedder(Protocol):
    """Vectors of texts; ``model`` names what made them and stays the same for a run."""

    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def clean_keywords(words: list, most: int = MOST["tags"]) -> list[str]:
    """Texts with single spaces, one of each spelling, the first ones."""
    flat = [" ".join(w.split()) for w in words if isinstance(w, str)]
    return list({w.lower(): w for w in reversed(flat) if w}.values())[::-1][:most]


class Words:
    """Frequent words are tags, long ones entities, neighbouring entities related."""

    def annotate(self, texts: list[str]) -> list[dict]:
        out = []
        for t in texts:
            words = [w for w in re.findall(r"[\w-]+", t) if len(w) >= 3 and w.lower() not in tx.QUERY_STOPWORDS]
            counts = Counter(w.lower() for w in words)
            names = sorted({w for w in words if len(w) >= 8}, key=lambda w: (-len(w), w))[:5]
            out.append({
                "chunk_type": "other", "summary": t[:200], "tags": sorted(counts, key=lambda w: (-counts[w], w))[: MOST["tags"]],
                "entities": [{"name": n, "type": "OTHER"} for n in names],
                "relationships": [{"source": a, "target": b, "type": "RELATED_TO"} for a, b in zip(names, names[1:])], "candidate_qas": [],
            })
        return out


class Phrases:
    """Tags are key phrases by association over the whole corpus, entities runs of capitalised words, neighbours related.

    It works on tables, not on texts one by one, and leaves no built-in function.
    """

    #: One capitalised word after another, not at the start of a sentence.
    NAMES = r"(?<![.!?]\s{0,3})(?<!^)\b\p{Lu}[\p{L}\p{N}_-]+(?: \p{Lu}[\p{L}\p{N}_-]+)*"

    def __init__(self, least: int = phrases.LEAST, threshold: float = phrases.THRESHOLD, longest: int = phrases.LONGEST):
        self.least, self.threshold, self.longest = least, threshold, longest

    def table(self, corpus: DataFrame, chunks: DataFrame) -> DataFrame:
        """``chunks`` with ``annotation``, JSON; counts are those of ``corpus``. A chunk_id has one text."""
        known = phrases.phrases(corpus, "text", self.least, self.threshold, self.longest)
        best = phrases.key_phrases(chunks.select("chunk_id", "text").distinct(), known, "chunk_id", "text", MOST["tags"], self.longest)
        tags = best.groupBy("chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "phrase"))), lambda x: x["phrase"]).alias("_tags"))
        text = F.coalesce("text", F.lit(""))
        names = F.slice(F.array_distinct(F.regexp_extract_all(tx.collapse(text), F.lit(self.NAMES), F.lit(0))), 1, MOST["entities"])
        entities = F.transform("_names", lambda n: F.struct(n.alias("name"), F.lit("OTHER").alias("type")))
        ends = F.arrays_zip(F.col("_names").alias("source"), F.slice("_names", F.lit(2), F.greatest(F.size("_names") - 1, F.lit(0))).alias("target"))
        related = F.transform(F.filter(ends, lambda x: x["target"].isNotNull()), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), F.lit("RELATED_TO").alias("type")))
        none = F.array().cast("array<struct<question:string,answer:string>>")
        whole = F.struct(
            F.lit("other").alias("chunk_type"), F.substring(text, 1, 200).alias("summary"), F.coalesce("_tags", F.array().cast("array<string>")).alias("tags"), entities.alias("entities"),
            F.slice(related, 1, MOST["relationships"]).alias("relationships"), none.alias("candidate_qas"),
        )
        rows = chunks.join(tags, "chunk_id", "left").withColumn("_names", names)
        return rows.select(*(F.col(c) for c in chunks.columns), F.to_json(whole).alias("annotation"))


class Prompted:
    """Annotates by a model: asked for JSON, asked again more strictly if the answer is none, then left empty.

    ``chat`` takes a prompt and returns text.
    """

    def __init__(self, chat, strict: str = "The last answer could not be read. Answer with JSON and nothing else.\n"):
        self.chat, self.strict = chat, strict

    def _ask(self, prompt: str, read):
        for asked in (prompt, self.strict + prompt):
            try:
                return read(self.chat(asked))
            except ValueError:
                continue
        return None

    def keywords(self, text: str, least: int = 6, most: int = MOST["tags"]) -> list[str]:
        def read(answer: str) -> list:
            try:
                return json_object(answer).get("keywords") or []
            except ValueError:
                return json_array(answer)

        return clean_keywords(self._ask(f'{least}-{most} keywords as {{"keywords": [...]}} of:\n{text}', read) or [], most)

    def query_entities(self, question: str, most: int = 3) -> list[str] | None:
        """Names in a question; null if the model gives none, and ``functions.text.question_entities`` then counts."""
        names = self._ask(f"A JSON array of at most {most} names in:\n{question}", json_array)
        return clean_keywords(names or [], most) or None

    def annotate(self, texts: list[str]) -> list[dict]:
        out = []
        for t in texts:
            own = self._ask(f"chunk_type, summary, entities, relationships, candidate_qas as one JSON object of:\n{t}", json_object) or {}
            rows = lambda name, own=own: [x for x in own.get(name) or [] if isinstance(x, dict)]
            text = lambda row, key, default="": str(row.get(key) or default).strip()
            entities = [{"name": text(e, "name"), "type": text(e, "type", "OTHER").upper()} for e in rows("entities")]
            relations = [{"source": text(r, "source"), "target": text(r, "target"), "type": text(r, "type", "RELATED_TO").upper()} for r in rows("relationships")]
            asked = [{"question": text(q, "question"), "answer": text(q, "answer")} for q in rows("candidate_qas")]
            out.append({
                "chunk_type": text(own, "chunk_type", "other"), "summary": own.get("summary"), "tags": self.keywords(t),
                "entities": [e for e in entities if e["name"]][: MOST["entities"]],
                "relationships": [r for r in relations if r["source"] and r["target"]][: MOST["relationships"]],
                "candidate_qas": [q for q in asked if q["question"] and q["answer"]][: MOST["candidate_qas"]],
            })
        return out


def annotated(chunks: DataFrame, annotator: Annotator) -> DataFrame:
    """``chunks`` (key columns and text) with ``annotation``, JSON; texts go in Arrow batches."""
    schema = chunks.select("*", F.lit("").alias("annotation")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = annotator.annotate(frame["text"].fillna("").tolist())
            yield frame.assign(annotation=[json.dumps(a, ensure_ascii=False) for a in made])

    return chunks.mapInPandas(run, schema)


def embedded(chunks: DataFrame, embedder: Embedder, fallback: Embedder | None = None) -> DataFrame:
    """``chunk_id``, ``embedding`` and ``embedding_model`` of chunks, ``BATCH`` texts a call, white space collapsed.

    A call that fails, or gives another number of vectors, goes to the fallback.
    """

    def vectors(texts: list[str]) -> tuple[list[list[float]], str]:
        try:
            made = embedder.embed(texts)
            if len(made) != len(texts):
                raise ValueError("another number of vectors than of texts")
            return made, embedder.model
        except Exception:
            if fallback is None:
                raise
            return fallback.embed(texts), fallback.model

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part = frame.iloc[at : at + BATCH]
                made, model = vectors([" ".join((t or "").split()) for t in part["text"]])
                yield pd.DataFrame({"chunk_id": part["chunk_id"].tolist(), "embedding": [[float(x) for x in v] for v in made], "embedding_model": model})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, embedding array<double>, embedding_model string")


def ingest(manifest: DataFrame, cache_path: str, as_of: str, annotator: Annotator | Phrases | None = None, size: int = 1200, overlap: int = 200) -> dict[str, DataFrame]:
    """The graph of a manifest with texts (doc_id, title, file_path, keywords, text): documents, chunks, tags, entities, relations, edges.

    Chunks whose document, settings and text the cache holds keep their annotation;
    the others are annotated, and a new version of the cache is written.
    """
    spark, settings = manifest.sparkSession, settings_key(size, overlap)
    key = F.coalesce(F.nullif(F.col("file_path"), F.lit("")), F.col("doc_id"))
    docs = stored(manifest.withColumn("key", key).withColumn("text_hash", F.sha1(F.coalesce("text", F.lit("")).cast("binary"))), "ingest_documents")
    cut = docs.select("key", "doc_id", "text_hash", F.explode(tx.windows(F.trim(F.coalesce("text", F.lit(""))), size, overlap)).alias("w"))
    chunks = cut.select("key", "doc_id", "text_hash", F.format_string("%s_c%03d", "doc_id", "w.index").alias("chunk_id"), F.col("w.index").alias("chunk_index"), F.col("w.text").alias("text"))
    chunks = chunks.withColumn("chunk_hash", F.sha1(F.col("text").cast("binary")))
    known = load_version(spark, cache_path, CACHE)
    valid = known.where(F.col("settings") == settings).select("key", "text_hash", "chunk_index", "chunk_hash", "annotation")
    on = ["key", "text_hash", "chunk_index", "chunk_hash"]
    valid = valid.groupBy(*on).agg(F.max("annotation").alias("annotation"))
    missing = chunks.join(valid.select(*on), on, "left_anti")
    new = annotator.table(chunks, missing) if isinstance(annotator, Phrases) else annotated(missing, annotator or Words())
    whole = stored(chunks.join(valid, on).select(*new.columns).unionByName(new), "ingest_chunks")
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    entries = whole.select("key", "text_hash", F.lit(settings).alias("settings"), "chunk_index", "chunk_hash", "annotation", now.alias("updated_at"))
    others = known.join(docs.select("key").distinct(), "key", "left_anti")
    save_version(others.unionByName(entries), cache_path)
    return graph_of(docs, whole, as_of)


def graph_of(docs: DataFrame, chunks: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Tables of annotated chunks, through the writes."""
    spark = docs.sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    stamps = "active boolean, created_at timestamp, updated_at timestamp"
    documents = writes.upsert(empty(f"doc_id string, title string, file_path string, source_keywords array<string>, {stamps}"), docs.select("doc_id", "title", "file_path", F.col("keywords").alias("source_keywords")), ["doc_id"], as_of)
    own, edges = writes.upsert_chunks(documents, empty(f"chunk_id string, doc_id string, chunk_index int, text string, {stamps}"), empty("src string, type string, dst string"), chunks.select("chunk_id", "doc_id", "chunk_index", "text"), as_of)
    read = chunks.select("chunk_id", read_annotation(F.col("annotation")).alias("a"))
    owners = own.select(F.col("chunk_id").alias("id"))
    tags, edges = writes.upsert_tags(empty("name string"), edges, read.select(F.col("chunk_id").alias("owner"), F.explode("a.tags").alias("tag")), owners)
    named = read.select(F.col("chunk_id").alias("owner"), F.explode("a.entities").alias("e")).select("owner", "e.name", "e.type")
    entities, edges = writes.upsert_entities(empty(f"name string, type string, {stamps}"), edges, named, owners, as_of)
    relations = empty("source string, source_type string, type string, target string, target_type string, props map<string,string>, updated_at timestamp")
    entities, relations = writes.upsert_relationships(entities, relations, read.select(F.explode("a.relationships").alias("raw")), as_of)
    return {"documents": documents, "chunks": own, "tags": tags, "entities": entities, "relations": relations, "edges": edges}


__all__ = ["ANNOTATION", "Annotator", "Embedder", "Phrases", "Prompted", "Words", "annotated", "clean_keywords", "embedded", "graph_of", "ingest"]
