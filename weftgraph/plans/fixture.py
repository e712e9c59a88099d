"""A property graph derived from the documents and conversations tables, by fixed rules.

What takes tokens of all texts is derived once in a session and written to the
shared folder; queries then read narrow tables, as they would read a graph that
was ingested before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import QUERY_STOPWORDS, windows
from ..functions.vectors import added_sums, hash_sums, text_sums
from ..operators import text_index, vector_index
from ..operators.words import Pick, top_words
from ..operators.writes import entity_id
from ..storage import file_states, shared_path, stored

_kept: dict[tuple, object] = {}


def kept(make):
    """A derived table (or index), written once for each session and state of the input files."""

    def get(self):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.state, make.__name__)
        if key not in _kept:
            made = make(self)
            _kept[key] = stored(made, make.__name__) if isinstance(made, DataFrame) else made
        return _kept[key]

    return property(get)


class Graph:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def state(self) -> tuple:
        """Names, times and sizes of the files of the tables that the graph is derived from."""
        return tuple(x for name in ("documents", "conversations") for x in file_states(self.spark, f"{self.sf_dir}/{name}.parquet"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.table("documents").select(F.format_string("doc_%03d", "doc_id").alias("doc_id"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("source_type"), (F.col("doc_id") % 17 != 0).alias("active"), F.col("doc_id").alias("number"), "lang", "text")

    def windows(self) -> DataFrame:
        """Chunks as they are cut from the texts."""
        docs = self.documents
        rows = docs.select("doc_id", "active", "lang", F.explode(windows(F.col("text"))).alias("w"))
        return rows.select(F.format_string("%s_c%03d", "doc_id", "w.index").alias("chunk_id"), "doc_id", F.col("w.index").alias("chunk_index"), F.col("w.text").alias("text"), "active", "lang")

    @kept
    def chunks(self) -> DataFrame:
        return self.windows()

    @kept
    def words(self) -> DataFrame:
        """The most frequent words of each chunk (``pick`` 0) and its longest ones (1)."""
        picks = [Pick(12, least=3, stop=frozenset(QUERY_STOPWORDS)), Pick(5, longest=True, least=8)]
        return top_words(self.chunks, "chunk_id", "text", picks, F.upper("lang"))

    @property
    def tags(self) -> DataFrame:
        return self.words.where("pick = 0").select("chunk_id", F.col("word").alias("tag"))

    @property
    def mentions(self) -> DataFrame:
        return self.words.where("pick = 1").select("chunk_id", F.col("kind").alias("type"), F.col("word").alias("name"), "place")

    @kept
    def relations(self) -> DataFrame:
        """Entities of neighbouring places in a chunk; the raw type goes round."""
        a, b = self.mentions.alias("a"), self.mentions.alias("b")
        raw = F.element_at(F.array(*map(F.lit, ["RELATED_TO", "uses", "part of", "mentions near"])), F.col("a.place"))
        return a.join(b, (F.col("a.chunk_id") == F.col("b.chunk_id")) & (F.col("b.place") == F.col("a.place") + 1)).select(F.col("a.name").alias("source"), F.col("b.name").alias("target"), raw.alias("raw_type"))

    @kept
    def keywords(self) -> DataFrame:
        return top_words(self.documents, "doc_id", "text", [Pick(5, longest=True)]).select("doc_id", F.col("word").alias("keyword"))

    @kept
    def edges(self) -> DataFrame:
        """Documents refer to the document of half their number; chunks lie in documents."""
        n = self.table("documents").select("doc_id").distinct()
        half = F.floor(F.col("doc_id") / 2)
        refers = n.select(F.format_string("doc_%03d", "doc_id").alias("src"), F.lit("REFERS_TO").alias("type"), F.format_string("doc_%03d", half.cast("long")).alias("dst")).where("src <> dst")
        return refers.unionByName(self.chunks.select(F.col("doc_id").alias("src"), F.lit("CONTAINS").alias("type"), F.col("chunk_id").alias("dst")))


    @kept
    def faqs(self) -> DataFrame:
        """A user's turn and the assistant's answer to it; ``chunk_id`` is the first chunk of a document, by the conversation's number."""
        t = self.table("conversations")
        a, b = t.where("role = 'user'").alias("a"), t.where("role = 'assistant'").alias("b")
        pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
        n = max(1, self.table("documents").select("doc_id").distinct().count())
        one = pairs.groupBy("a.conv_id", "a.turn").agg(F.min(F.col("a.text")).alias("question"), F.min(F.col("b.text")).alias("answer"))
        return one.select(F.format_string("faq_%d_%d", "conv_id", "turn").alias("faq_id"), "question", "answer", F.lit(True).alias("active"), F.format_string("doc_%03d_c000", F.col("conv_id") % n).alias("chunk_id"))

    @property
    def vectors(self) -> DataFrame:
        """The vector of a number is that of the first chunk of the document of this number."""
        return self.table("embeddings").select(F.format_string("doc_%03d_c000", "vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    @kept
    def texts(self) -> DataFrame:
        """The distinct texts of chunks: ``chunk_id`` is the least of those that have it."""
        return self.chunks.groupBy("text").agg(F.min("chunk_id").alias("chunk_id")).select("chunk_id", "text")

    @kept
    def first_sums(self) -> DataFrame:
        return text_sums(self.windows(), "chunk_id", "text", 384)

    @property
    def text_sums(self) -> DataFrame:
        """The hashed embedding of each distinct text, but for its length: places and parts of what isn't zero."""
        return added_sums(self.first_sums, "chunk_id")

    @property
    def chunk_sums(self) -> DataFrame:
        """The embedding of each chunk that has a token, but for its length, made where chunks are read."""
        return hash_sums(self.chunks, "chunk_id", "text", 384)

    @kept
    def text_index(self):
        return text_index.index(self.chunks, self.mentions, self.tags, shared_path(self.spark, "text_index"))

    @kept
    def vector_index(self):
        return vector_index.build(self.table("embeddings"), "vec_id", "embedding", shared_path(self.spark, "vector_index"), 64)

    @kept
    def all_edges(self) -> DataFrame:
        """Also tags, entities and what FAQs are derived from, where the chunk exists."""
        edge = lambda df, src, kind, dst: df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
        ids = self.chunks.select("chunk_id")
        tagged = edge(self.tags, F.col("chunk_id"), "HAS_TAG", F.concat(F.lit("t:"), "tag"))
        named = edge(self.mentions, F.col("chunk_id"), "MENTIONS", entity_id())
        derived = edge(self.faqs.join(ids, "chunk_id", "left_semi"), F.col("faq_id"), "DERIVED_FROM", F.col("chunk_id"))
        return self.edges.unionByName(tagged).unionByName(named).unionByName(derived)

    @kept
    def nodes(self) -> DataFrame:
        """(id, label, name, type, question, answer) of all."""
        none = F.lit(None).cast("string")

        def node(df, key, label, name=none, kind=none, question=none, answer=none):
            return df.select(key.alias("id"), F.lit(label).alias("label"), name.alias("name"), kind.alias("type"), question.alias("question"), answer.alias("answer")).distinct()

        out = node(self.documents, F.col("doc_id"), "Document").unionByName(node(self.chunks, F.col("chunk_id"), "Chunk"))
        out = out.unionByName(node(self.tags, F.concat(F.lit("t:"), "tag"), "Tag", F.col("tag"))).unionByName(node(self.mentions, entity_id(), "Entity", F.col("name"), F.col("type")))
        return out.unionByName(node(self.faqs, F.col("faq_id"), "FAQ", none, none, F.col("question"), F.col("answer")))


_STOP = ", ".join(f"'{w}'" for w in QUERY_STOPWORDS)
#: The same tables in DuckDB.
SQL = rf"""WITH RECURSIVE d AS (SELECT printf('doc_%03d', doc_id) AS doc_id, substring(text, 1, 60) AS title, source AS source_type, doc_id % 17 <> 0 AS active, doc_id AS number, lang, text FROM documents),
w AS (SELECT *, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1200 THEN 1 ELSE CAST(ceil((length(text) - 200) / 1000.0) AS BIGINT) END)) AS i FROM d),
c AS (SELECT printf('%s_c%03d', doc_id, i) AS chunk_id, doc_id, i AS chunk_index, substring(text, i * 1000 + 1, 1200) AS text, active, lang FROM w),
tok AS (SELECT chunk_id, lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+')) AS t FROM c),
tg AS (SELECT chunk_id, tag FROM (SELECT chunk_id, t AS tag, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, t) AS place FROM tok WHERE length(t) >= 3 AND t NOT IN ({_STOP}) GROUP BY chunk_id, t) WHERE place <= 12),
en AS (SELECT * FROM (SELECT chunk_id, upper(lang) AS type, t AS name, row_number() OVER (PARTITION BY chunk_id ORDER BY length(t) DESC, t) AS place FROM (SELECT DISTINCT chunk_id, lang, t FROM tok) WHERE length(t) >= 8) WHERE place <= 5),
rel AS (SELECT a.name AS source, b.name AS target, ['RELATED_TO', 'uses', 'part of', 'mentions near'][a.place] AS raw_type FROM en a JOIN en b ON a.chunk_id = b.chunk_id AND b.place = a.place + 1),
kw AS (SELECT doc_id, keyword FROM (SELECT doc_id, t AS keyword, row_number() OVER (PARTITION BY doc_id ORDER BY length(t) DESC, t) AS place FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+')) AS t FROM d)) WHERE place <= 5),
e AS (SELECT * FROM (SELECT printf('doc_%03d', doc_id) AS src, 'REFERS_TO' AS type, printf('doc_%03d', doc_id // 2) AS dst FROM (SELECT DISTINCT doc_id FROM documents)) WHERE src <> dst UNION ALL SELECT doc_id, 'CONTAINS', chunk_id FROM c)
"""
#: FAQs, all edges and all nodes.
GRAPH_SQL = SQL + """, f AS (SELECT printf('faq_%d_%d', conv_id, turn) AS faq_id, question, answer, printf('doc_%03d_c000', conv_id % (SELECT count(DISTINCT doc_id) FROM documents)) AS chunk_id FROM (SELECT a.conv_id, a.turn, min(a.text) AS question, min(b.text) AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' GROUP BY 1, 2)),
ae AS (SELECT src, type, dst FROM e UNION ALL SELECT chunk_id, 'HAS_TAG', 't:' || tag FROM tg UNION ALL SELECT chunk_id, 'MENTIONS', 'e:' || type || '|' || name FROM en UNION ALL SELECT faq_id, 'DERIVED_FROM', chunk_id FROM f WHERE chunk_id IN (SELECT chunk_id FROM c)),
an AS (SELECT DISTINCT doc_id AS id, 'Document' AS label, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS type FROM d UNION SELECT chunk_id, 'Chunk', NULL, NULL FROM c UNION SELECT 't:' || tag, 'Tag', tag, NULL FROM tg UNION SELECT 'e:' || type || '|' || name, 'Entity', name, type FROM en UNION SELECT faq_id, 'FAQ', NULL, NULL FROM f)
"""
