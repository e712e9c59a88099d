"""Queries on the fixture graph and their DuckDB equivalents, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.splitting import by_separators
from ..functions.vectors import cosine, hash_embedding
from ..operators import answer, context, hybrid, kb, search, traverse, writes
from ..sources import annotation_json, read_annotation, worklist
from .fixture import GRAPH_SQL, SQL, Graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
QUESTION = "What about the thing and question"
TERMS = ["thing", "question"]
AS_OF = "2024-06-01 00:00:00"


def query(sql: str | None = None, tables: str = SQL) -> Callable:
    """Registers a function of a Graph under its name, with SQL after the fixture's tables."""

    def register(f: Callable[[Graph], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = tables + sql
        return f

    return register


@query("SELECT chunk_id, doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, text FROM c")
def chunk_windows(g):
    return g.windows().select("chunk_id", "doc_id", "chunk_index", "text")


_HIT = "list_filter(['thing', 'question'], lambda t: {})"
_NAMES = "len(list_filter({0}, lambda n: contains(n, t) OR contains(t, n))) > 0"


def _lexical(empty: str) -> str:
    return f"""SELECT chunk_id, text, doc_id, title, CAST(chunk_index AS INTEGER) AS chunk_index, score FROM (
SELECT c.chunk_id, c.text, c.doc_id, c.chunk_index, CAST(3 * len({_HIT.format("contains(lower(c.text), t)")}) + 2 * len({_HIT.format(_NAMES.format(f"coalesce(x.names, {empty})"))}) + len({_HIT.format(_NAMES.format(f"coalesce(y.names, {empty})"))}) AS DOUBLE) AS score
FROM c LEFT JOIN (SELECT chunk_id, list(DISTINCT name) AS names FROM en GROUP BY chunk_id) x USING (chunk_id) LEFT JOIN (SELECT chunk_id, list(DISTINCT tag) AS names FROM tg GROUP BY chunk_id) y USING (chunk_id) WHERE c.active)
LEFT JOIN (SELECT doc_id, title FROM d) USING (doc_id) WHERE score > 0 ORDER BY score DESC, chunk_index, chunk_id LIMIT 12"""


@query(_lexical("CAST([] AS VARCHAR[])"))
def lexical_search(g):
    return search.lexical_search(g.chunks, g.documents, g.mentions, g.tags, QUESTION)


@query(_lexical("['']"))
def lexical_search_compat(g):
    return search.lexical_search(g.chunks, g.documents, g.mentions, g.tags, QUESTION, compat=True)


@query(f"""SELECT item_id, array_to_string(CASE WHEN len(k) > 0 THEN k[1:8] ELSE [trim(lower(text))] END, '|') AS terms FROM (SELECT item_id, text, list_filter(list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1]), lambda x: length(x) >= 3 AND x NOT IN ({", ".join(f"'{w}'" for w in tx.QUERY_STOPWORDS)})) AS k FROM (SELECT item_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+') AS t FROM benchmark))""")
def query_terms(g):
    return g.table("benchmark").select("item_id", F.array_join(tx.query_terms(F.col("text")), "|").alias("terms"))


def _vector(g) -> list[float]:
    return g.table("embeddings").where("vec_id = 0").select("embedding").first()[0]


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 8")
def knn_cosine(g):
    return search.nearest(g.table("embeddings"), "vec_id", "embedding", _vector(g)).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))), 6) AS score FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 8")
def knn_euclidean(g):
    return search.nearest(g.table("embeddings"), "vec_id", "embedding", _vector(g), metric="euclidean").select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT DISTINCT len(embedding) AS dims FROM embeddings")
def embedding_dim(g):
    return g.table("embeddings").select(F.size("embedding").cast("long").alias("dims")).distinct()


_FOLD = "list_reduce(list_transform(range(1, 41), lambda i: CAST(instr('0123456789abcdef', substr(h, i, 1)) - 1 AS BIGINT)), lambda a, x: (a * 16 + x) % {0})"


@query(f""", t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+')) AS token FROM d),
n AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY 1, 2),
o AS (SELECT token, {_FOLD.format(384)} AS dim, (CASE WHEN {_FOLD.format(4)} >= 2 THEN 1.0 ELSE -1.0 END) * (1 + CAST({_FOLD.format(997)} AS DOUBLE) / 9970) AS each FROM (SELECT token, sha1(token) AS h FROM (SELECT DISTINCT token FROM n))),
s AS (SELECT doc_id, dim, sum(each * n) AS w FROM n JOIN o USING (token) GROUP BY 1, 2)
SELECT doc_id, dim, round(CASE WHEN norm > 0 THEN w / norm ELSE 0 END, 6) AS weight FROM s JOIN (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM s GROUP BY doc_id) USING (doc_id)
UNION ALL SELECT DISTINCT doc_id, 0, 0.0 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM s)""")
def hash_embedding_query(g):
    return hash_embedding(g.documents, "doc_id", "text").select("doc_id", "dim", F.round("weight", 6).alias("weight"))


_SEED = """, h AS (SELECT chunk_id, 0 AS branch, term FROM en, (SELECT unnest({terms}) AS term) WHERE contains(lower(name), term) UNION ALL SELECT chunk_id, 1, term FROM tg, (SELECT unnest({terms}) AS term) WHERE contains(lower(tag), term)),
m AS (SELECT chunk_id, branch, chunk_index, count(DISTINCT term) AS match_count FROM h JOIN c USING (chunk_id) WHERE active GROUP BY 1, 2, 3)
SELECT chunk_id, CAST(chunk_index AS INTEGER) AS chunk_index, match_count, CAST(branch AS INTEGER) AS branch FROM m WHERE branch = (SELECT min(branch) FROM m) ORDER BY match_count DESC, chunk_index, chunk_id LIMIT 8"""


@query(_SEED.format(terms="['then', 'ation']"))
def seed_by_entity(g):
    return search.seeds(g.chunks, g.mentions, g.tags, ["then", "ation"])


@query(_SEED.format(terms="['clown', 'idiot']"))
def seed_by_tag(g):
    """Words that tags have and no entity contains: the data decides for tags."""
    return search.seeds(g.chunks, g.mentions, g.tags, ["clown", "idiot"])


@query("""SELECT chunk_id, round(coalesce(1.0 / (60 + gr), 0) + coalesce(1.0 / (60 + vr), 0) + 0.15 * coalesce(vn, 0), 6) AS merge_score, gr IS NOT NULL AS has_graph FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS gr FROM (SELECT chunk_id FROM c ORDER BY chunk_id LIMIT 8)) FULL JOIN (SELECT *, CASE WHEN max(vs) OVER () = min(vs) OVER () THEN 1.0 ELSE (vs - min(vs) OVER ()) / (max(vs) OVER () - min(vs) OVER ()) END AS vn FROM (SELECT chunk_id, row_number() OVER (ORDER BY n DESC, chunk_id) AS vr, CAST(n AS DOUBLE) AS vs FROM (SELECT chunk_id, length(text) + chunk_index AS n FROM c ORDER BY n DESC, chunk_id LIMIT 6))) USING (chunk_id)""")
def rrf_merge(g):
    own = g.chunks.select("chunk_id", (F.length("text") + F.col("chunk_index")).alias("n"))
    graph = own.orderBy("chunk_id").limit(8).withColumn("rank", F.row_number().over(Window.orderBy("chunk_id")))
    best = own.orderBy(F.desc("n"), "chunk_id").limit(6)
    vector = best.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("n"), "chunk_id")).alias("rank"), F.col("n").cast("double").alias("vector_score"))
    return hybrid.fuse(graph, vector).select("chunk_id", F.round("merge_score", 6).alias("merge_score"), "has_graph")


@query("SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT name, type FROM en)) AS entities, (SELECT count(DISTINCT tag) FROM tg) AS tags, (SELECT count(*) FROM (SELECT DISTINCT * FROM ae)) AS relationships", GRAPH_SQL)
def graph_stats(g):
    """Counts of the stored tables: one row from each, put together by name."""
    tables = {"documents": g.documents, "chunks": g.chunks, "entities": g.mentions.select("name", "type").distinct(), "tags": g.tags.select("tag").distinct(), "relationships": g.all_edges.distinct()}
    counts = None
    for name, df in tables.items():
        own = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = own if counts is None else counts.unionByName(own)
    return counts.groupBy().pivot("name", list(tables)).agg(F.max("n"))


@query("SELECT tag, count(*) AS uses FROM tg GROUP BY tag ORDER BY uses DESC, tag LIMIT 20")
def tag_usage_top20(g):
    return g.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "tag").limit(20)


@query("SELECT doc_id, count(*) AS chunks FROM c GROUP BY doc_id")
def chunks_per_document(g):
    return g.chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


_LIST = "SELECT doc_id, title, coalesce(keywords, '') AS keywords FROM ({0}) LEFT JOIN (SELECT doc_id, array_to_string(list_sort(list(DISTINCT keyword)), '|') AS keywords FROM kw GROUP BY doc_id) USING (doc_id)"


@query(_LIST.format("SELECT doc_id, title FROM d ORDER BY title, doc_id LIMIT 50"))
def list_documents(g):
    return kb.list_documents(g.documents, g.keywords)


@query(_LIST.format("SELECT doc_id, title FROM d WHERE doc_id = 'doc_007'"))
def doc_by_path(g):
    return kb.document_by_key(g.documents, g.keywords, "doc_007")


@query(_LIST.format("SELECT doc_id, title FROM d WHERE doc_id IN (SELECT doc_id FROM kw WHERE keyword IN (SELECT keyword FROM kw WHERE doc_id IN ('doc_001', 'doc_002'))) ORDER BY title, doc_id LIMIT 50"))
def kw_any(g):
    words = [r[0] for r in g.keywords.where("doc_id in ('doc_001', 'doc_002')").select("keyword").collect()]
    return kb.by_keywords(g.documents, g.keywords, words)


@query(_LIST.format("SELECT doc_id, title FROM d WHERE doc_id IN (SELECT doc_id FROM kw WHERE keyword IN (SELECT keyword FROM kw WHERE doc_id = 'doc_001') GROUP BY doc_id HAVING count(DISTINCT keyword) = (SELECT count(*) FROM kw WHERE doc_id = 'doc_001')) ORDER BY title, doc_id LIMIT 50"))
def kw_all(g):
    words = [r[0] for r in g.keywords.where("doc_id = 'doc_001'").select("keyword").collect()]
    return kb.by_keywords(g.documents, g.keywords, words, "all")


@query(_LIST.format("SELECT doc_id, title FROM d WHERE contains(lower(title), 'the') ORDER BY title, doc_id LIMIT 50"))
def title_search(g):
    return kb.by_title(g.documents, g.keywords, "The")


_EDGES = "(SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common_keywords FROM kw a JOIN kw b ON a.keyword = b.keyword AND a.doc_id < b.doc_id GROUP BY 1, 2)"
_NEAR = f"(SELECT CASE WHEN a = 'doc_001' THEN b ELSE a END AS doc_id, common_keywords FROM {_EDGES} WHERE a = 'doc_001' OR b = 'doc_001')"


@query(f"SELECT * FROM {_EDGES}")
def similarity_edges(g):
    return kb.similarity_edges(g.keywords)


@query(f"SELECT doc_id, title, common_keywords FROM {_NEAR} JOIN d USING (doc_id) ORDER BY common_keywords DESC, title, doc_id LIMIT 10")
def similar_documents(g):
    return kb.similar(g.keywords, g.documents, "doc_001")


@query(f"SELECT doc_id, title, CAST(10 * common_keywords + coalesce(shared, 0) AS BIGINT) AS relevance FROM {_NEAR} LEFT JOIN (SELECT doc_id, count(DISTINCT keyword) AS shared FROM kw WHERE keyword IN (SELECT keyword FROM kw WHERE doc_id = 'doc_001') GROUP BY doc_id) USING (doc_id) JOIN d USING (doc_id) ORDER BY relevance DESC, title, doc_id LIMIT 10")
def related_documents(g):
    return kb.related(g.keywords, g.documents, "doc_001")


_TOP_NAME = "(SELECT name FROM en GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"


def _top_name(g) -> str:
    return g.mentions.groupBy("name").count().orderBy(F.desc("count"), "name").first()[0]


@query(f"SELECT doc_id, title, chunks_count FROM (SELECT doc_id, count(DISTINCT chunk_id) AS chunks_count FROM en JOIN c USING (chunk_id) WHERE name = {_TOP_NAME} GROUP BY doc_id) JOIN d USING (doc_id) ORDER BY chunks_count DESC, title, doc_id LIMIT 10")
def docs_by_entity(g):
    return kb.by_entity(g.documents, g.chunks, g.mentions, _top_name(g))


@query(f"SELECT DISTINCT * FROM (SELECT target AS name, raw_type AS type, 'out' AS direction FROM rel WHERE source = {_TOP_NAME} UNION ALL SELECT source, raw_type, 'in' FROM rel WHERE target = {_TOP_NAME})")
def entity_context(g):
    return traverse.entity_context(g.relations.withColumnRenamed("raw_type", "type"), _top_name(g))


_BALL = ", two AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e), r(id, depth) AS (SELECT 'doc_003', 0 UNION SELECT two.b, r.depth + 1 FROM r JOIN two ON r.id = two.a WHERE r.depth < 2), nodes AS (SELECT id, min(depth) AS depth FROM r GROUP BY id ORDER BY depth, id LIMIT 50) "


@query(_BALL + "SELECT id, CAST(depth AS INTEGER) AS depth FROM nodes")
def expand_nodes(g):
    return traverse.expand(g.edges, g.spark.createDataFrame([("doc_003",)], "id string"), 2, 50)[0]


@query(_BALL + "SELECT DISTINCT src, type, dst FROM e WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def expand_edges(g):
    return traverse.expand(g.edges, g.spark.createDataFrame([("doc_003",)], "id string"), 2, 50)[1]


@query(", two AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e), r(id, depth) AS (SELECT 'doc_005', 0 UNION SELECT two.b, r.depth + 1 FROM r JOIN two ON r.id = two.a WHERE r.depth < 5) SELECT CAST(min(depth) AS INTEGER) AS distance FROM r WHERE id = 'doc_006' HAVING min(depth) IS NOT NULL")
def path_distance(g):
    return traverse.shortest_path(g.edges, "doc_005", "doc_006").select("distance")


@query("SELECT source, target, CASE WHEN t IN ('RELATED_TO', 'USES', 'PART_OF') THEN t ELSE 'RELATED_TO' END AS type, CASE WHEN t NOT IN ('RELATED_TO', 'USES', 'PART_OF') THEN raw_type END AS raw_type FROM (SELECT *, replace(upper(raw_type), ' ', '_') AS t FROM rel)")
def normalize_relationships(g):
    raw = F.col("raw_type")
    return g.relations.select("source", "target", tx.relation_type(raw).alias("type"), tx.raw_relation_type(raw).alias("raw_type"))


@query("SELECT doc_id, CASE WHEN number % 2 = 0 THEN reverse(title) ELSE title END AS title, CASE WHEN number % 2 = 0 THEN true ELSE active END AS active, number % 2 = 0 AS changed FROM d")
def upsert_documents(g):
    old = g.documents.select("doc_id", "title", "active", "number", F.lit(None).cast("timestamp").alias("updated_at"))
    new = old.where("number % 2 = 0").select("doc_id", F.reverse("title").alias("title"))
    return writes.upsert(old, new, ["doc_id"], AS_OF).select("doc_id", "title", "active", F.col("updated_at").isNotNull().alias("changed"))


@query("""SELECT 'document' AS kind, doc_id AS id, CASE WHEN doc_id = 'doc_003' THEN false ELSE active END AS active FROM d UNION ALL SELECT 'chunk', chunk_id, CASE WHEN doc_id = 'doc_003' THEN false ELSE active END FROM c
UNION ALL SELECT 'faq', faq_id, chunk_id NOT IN (SELECT chunk_id FROM c WHERE doc_id = 'doc_003') FROM f""", GRAPH_SQL)
def soft_delete(g):
    """All three marked tables; an FAQ goes with any of its chunks."""
    documents, chunks, faqs = writes.soft_delete(g.documents, g.chunks, g.faqs.select("faq_id", "active"), g.faqs.select("faq_id", "chunk_id"), "doc_003")
    parts = (("document", documents, "doc_id"), ("chunk", chunks, "chunk_id"), ("faq", faqs, "faq_id"))
    rows = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "active") for kind, df, key in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT DISTINCT src, type, dst FROM ae WHERE type <> 'HAS_TAG' OR dst < 't:m'", GRAPH_SQL)
def link_edges(g):
    """Two sets of edges that overlap: each edge once."""
    low = g.all_edges.where("type <> 'HAS_TAG'")
    return writes.upsert_edges(low, g.all_edges.where("type = 'MENTIONS' or type = 'HAS_TAG' and dst < 't:m'"))


@query("SELECT doc_id AS key, sha1(text) AS text_hash FROM d WHERE number % 3 <> 0")
def cache_worklist(g):
    rows = g.documents.select(F.col("doc_id").alias("key"), "text", "number")
    cache = rows.where("number % 3 = 0").select("key", F.sha1(F.col("text").cast("binary")).alias("text_hash"))
    return worklist(rows, cache).select("key", "text_hash")


@query(r"""SELECT page_id, array_to_string(list_filter(list_transform(list_filter(list_zip(u, range(1, len(u) + 1)), lambda z: list_position(u, z[1]) = z[2]), lambda z: z[1]), lambda x: x <> ''), '|') AS urls
FROM (SELECT page_id, list_transform(regexp_extract_all(url || ' ' || coalesce(html, ''), 'https?://[^\s<>\]"'')]+'), lambda x: rtrim(x, '.,;:)]}>')) AS u FROM pages)""")
def extract_urls(g):
    text = F.concat("url", F.lit(" "), F.coalesce("html", F.lit("")))
    return g.table("pages").select("page_id", F.array_join(tx.urls(text), "|").alias("urls"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN substring(t, 1, 77) || '...' ELSE t END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[\\p{Z}\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85]+', ' ', 'g')) AS t FROM d)")
def shorten_text(g):
    return g.documents.select("doc_id", tx.shorten(F.col("text"), 80).alias("short"))


@query("SELECT conv_id, a.turn AS turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b USING (conv_id) WHERE a.role = 'user' AND b.role = 'assistant' AND b.turn = a.turn + 1")
def faqs(g):
    t = g.table("conversations")
    a, b = t.where("role = 'user'").alias("a"), t.where("role = 'assistant'").alias("b")
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)).select("a.conv_id", "a.turn", F.col("a.text").alias("question"), F.col("b.text").alias("answer"))


@query()
def recursive_chunks(g):
    return by_separators(g.documents, "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("SELECT DISTINCT name, type FROM en WHERE contains(name, 'ation') ORDER BY name, type LIMIT 10")
def entity_search(g):
    return g.mentions.where(F.contains(F.lower("name"), F.lit("ation"))).select("name", "type").distinct().orderBy("name", "type").limit(10)


@query("SELECT DISTINCT source, raw_type AS type, target FROM rel ORDER BY source, type, target LIMIT 50")
def entity_pairs(g):
    return g.relations.select("source", F.col("raw_type").alias("type"), "target").distinct().orderBy("source", "type", "target").limit(50)


@query("SELECT doc_id, title FROM d WHERE contains(lower(title), 'thing') OR contains(lower(text), 'thing') OR doc_id IN (SELECT doc_id FROM tg JOIN c USING (chunk_id) WHERE contains(tag, 'thing')) ORDER BY title, doc_id LIMIT 10")
def docs_search_strict(g):
    return kb.by_topic(g.documents, g.chunks, g.tags, "Thing")


@query(_LIST.format("SELECT doc_id, title FROM d WHERE doc_id IN (SELECT doc_id FROM kw WHERE keyword = (SELECT min(keyword) FROM kw WHERE doc_id = 'doc_001')) ORDER BY title, doc_id LIMIT 50"))
def kw_search(g):
    word = g.keywords.where("doc_id = 'doc_001'").agg(F.min("keyword")).first()[0]
    return kb.by_keywords(g.documents, g.keywords, [word])


@query("SELECT doc_id, chunk_id, coalesce(title, '') AS title, CAST(NULL AS VARCHAR) AS url, CAST(length(s.text) AS DOUBLE) AS score FROM (SELECT * FROM c ORDER BY length(text) DESC, chunk_id LIMIT 10) s LEFT JOIN (SELECT doc_id, title FROM d) USING (doc_id)")
def citations(g):
    seeds = g.chunks.select("chunk_id", "doc_id", F.length("text").alias("retrieval_score"), (-F.length("text")).alias("place"))
    return context.citations(seeds, g.documents)


_NODES = "(SELECT DISTINCT 'e:' || name AS id, 'Entity' AS label, name FROM en UNION SELECT DISTINCT 't:' || tag, 'Tag', tag FROM tg)"


def _nodes(g) -> DataFrame:
    names = g.mentions.select(F.concat(F.lit("e:"), "name").alias("id"), F.lit("Entity").alias("label"), "name")
    return names.unionByName(g.tags.select(F.concat(F.lit("t:"), "tag").alias("id"), F.lit("Tag").alias("label"), F.col("tag").alias("name"))).distinct()


@query(f"SELECT term, id, name FROM (SELECT term, id, name, row_number() OVER (PARTITION BY term ORDER BY lower(name) <> term, label <> 'Entity', length(name), lower(name), id) AS place FROM {_NODES}, (SELECT unnest(['thing', 'question', 'ation', 'was', 'zzzz']) AS term) WHERE contains(lower(name), term)) WHERE place = 1")
def keyword_nodes(g):
    return context.keyword_nodes(_nodes(g), ["thing", "question", "ation", "was", "zzzz"])


def _cut(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) > {n} THEN substring({text}, 1, {n}) || '…' ELSE {text} END"


def _section(rank: int, head: str, rows: str, joint: str, order: str) -> str:
    return f"SELECT {rank} AS rank, '{head}:' || chr(10) || string_agg(line, {joint} ORDER BY {order}) AS section FROM ({rows})"


_CHUNK_LINE = "'- chunk_id=' || chunk_id || ' doc_id=' || doc_id || ' :: ' || " + _cut("replace(trim(text, ' '), chr(10), ' ')", 800) + " AS line"
_RENDERED = f""", b AS ({_lexical("CAST([] AS VARCHAR[])")}),
sections AS ({_section(1, "DOCUMENTS", "SELECT DISTINCT doc_id, '- ' || coalesce(title, '') || ' (doc_id=' || doc_id || ')' AS line FROM b", "chr(10)", "doc_id, line")}
UNION ALL {_section(2, "TAGS", "SELECT DISTINCT tag AS line FROM tg WHERE chunk_id IN (SELECT chunk_id FROM b) ORDER BY tag LIMIT 30", "', '", "line")}
UNION ALL {_section(3, "ENTITIES", "SELECT DISTINCT name, type, name || '[' || type || ']' AS line FROM en WHERE chunk_id IN (SELECT chunk_id FROM b) ORDER BY name, type LIMIT 30", "', '", "name, type")}
UNION ALL {_section(4, "SEED CHUNKS", f"SELECT score, chunk_id, {_CHUNK_LINE} FROM b ORDER BY score DESC, chunk_id LIMIT 20", "chr(10)", "score DESC, chunk_id")}
UNION ALL {_section(5, "NEIGHBOR CHUNKS", f"SELECT chunk_index, chunk_id, {_CHUNK_LINE} FROM c WHERE doc_id IN (SELECT doc_id FROM b) AND chunk_id NOT IN (SELECT chunk_id FROM b) ORDER BY chunk_index, chunk_id LIMIT 20", "chr(10)", "chunk_index, chunk_id")}
UNION ALL {_section(6, "FAQ (linked)", f"SELECT question, answer, '- Q: ' || trim(question, ' ') || chr(10) || '  A: ' || {_cut("trim(answer, ' ')", 300)} AS line FROM f WHERE chunk_id IN (SELECT doc_id || '_c000' FROM b) ORDER BY question, answer LIMIT 10", "chr(10)", "question, answer")})
SELECT coalesce(string_agg(section, chr(10) || chr(10) ORDER BY rank), 'No graph context found.') AS context FROM sections"""


@query(_RENDERED, GRAPH_SQL)
def render_context(g):
    best = lexical_search(g)
    keys = best.select("chunk_id")
    seeds = best.select("chunk_id", "doc_id", "text", (-F.col("score")).alias("place"))
    near = g.chunks.join(best.select("doc_id").distinct(), "doc_id", "left_semi").join(keys, "chunk_id", "left_anti").select("chunk_id", "doc_id", "text", F.col("chunk_index").alias("place"))
    asked = g.faqs.join(best.select("doc_id").distinct().select(F.concat("doc_id", F.lit("_c000")).alias("chunk_id")), "chunk_id", "left_semi").select("question", "answer")
    return context.render(best.select("doc_id", "title"), g.tags.join(keys, "chunk_id", "left_semi").select("tag"), g.mentions.join(keys, "chunk_id", "left_semi").select("name", "type"), seeds, near, asked)


_DOCS_BY_TITLE = "SELECT DISTINCT doc_id, title FROM d ORDER BY title, doc_id LIMIT 10"


@query(_DOCS_BY_TITLE)
def docs_search_compat(g):
    return kb.by_topic(g.documents, g.chunks, g.tags, "Thing", compat=True)


@query(_lexical("CAST([] AS VARCHAR[])").replace("SELECT chunk_id, text, doc_id, title,", "SELECT chunk_id, text, doc_id, title, 'https://docs.example/' || doc_id AS url,", 1))
def lexical_search_url(g):
    documents = g.documents.withColumn("url", F.concat(F.lit("https://docs.example/"), "doc_id"))
    return search.lexical_search(g.chunks, documents, g.mentions, g.tags, QUESTION, with_url=True)


_AROUND = ", two AS (SELECT src AS a, dst AS b FROM ae UNION ALL SELECT dst, src FROM ae), r(id, depth) AS (SELECT {seed}, 0 UNION SELECT two.b, r.depth + 1 FROM r JOIN two ON r.id = two.a WHERE r.depth < 2), near AS (SELECT id, label, depth FROM (SELECT id, min(depth) AS depth FROM r GROUP BY id) JOIN (SELECT id, label FROM an) USING (id) ORDER BY depth, label, id LIMIT {limit}) "


@query(_AROUND.format(seed="'doc_003'", limit=100) + "SELECT id, label, CAST(depth AS INTEGER) AS depth FROM near", GRAPH_SQL)
def doc_neighborhood(g):
    """Two hops around a document over all kinds of edges."""
    return traverse.subgraph(g.all_edges, g.nodes, g.spark.createDataFrame([("doc_003",)], "id string"), 2, 100, label="Document")[0]


@query(_AROUND.format(seed="'doc_003'", limit=100) + "SELECT DISTINCT src, type, dst FROM ae WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)", GRAPH_SQL)
def doc_neighborhood_edges(g):
    return traverse.subgraph(g.all_edges, g.nodes, g.spark.createDataFrame([("doc_003",)], "id string"), 2, 100, label="Document")[1]


@query(_AROUND.format(seed="'doc_003'", limit=100) + "SELECT label, count(*) AS nodes FROM near WHERE label <> 'FAQ' GROUP BY label", GRAPH_SQL)
def label_histogram(g):
    """Nodes of a neighbourhood by label, without FAQs."""
    near = traverse.subgraph(g.all_edges, g.nodes, g.spark.createDataFrame([("doc_003",)], "id string"), 2, 100, include_faq=False)[0]
    return near.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT type, count(*) AS edges FROM (SELECT DISTINCT * FROM ae) GROUP BY type", GRAPH_SQL)
def edges_by_type(g):
    return g.all_edges.distinct().groupBy("type").agg(F.count(F.lit(1)).alias("edges"))


@query(", two AS (SELECT a, b, min(type) AS type FROM (SELECT src AS a, dst AS b, type FROM e UNION ALL SELECT dst, src, type FROM e) GROUP BY a, b), r(id, p, t) AS (SELECT 'doc_005', ['doc_005'], CAST([] AS VARCHAR[]) UNION ALL SELECT two.b, list_append(p, two.b), list_append(t, two.type) FROM r JOIN two ON r.id = two.a WHERE len(p) < 6 AND r.id <> 'doc_006' AND NOT list_contains(p, two.b)) SELECT CAST(len(p) - 1 AS INTEGER) AS distance, array_to_string(p, '|') AS nodes, array_to_string(t, '|') AS relations FROM r WHERE id = 'doc_006' ORDER BY len(p), p LIMIT 1")
def shortest_path(g):
    return traverse.shortest_path(g.edges, "doc_005", "doc_006").select("distance", F.array_join("nodes", "|").alias("nodes"), F.array_join("relations", "|").alias("relations"))


def _two_names(g) -> tuple[str, str]:
    """The two longest entities of one chunk."""
    names = g.mentions.where("place <= 2").groupBy("chunk_id").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b")
    return tuple(names.orderBy("chunk_id").select("a", "b").first())


@query("SELECT CAST(2 AS INTEGER) AS distance, a || '||' || b AS path_nodes, 'MENTIONS|MENTIONS' AS relations FROM (SELECT chunk_id, min(name) AS a, max(name) AS b FROM en WHERE place <= 2 GROUP BY chunk_id HAVING min(name) <> max(name) ORDER BY chunk_id LIMIT 1)")
def entity_path(g):
    """Two names of one chunk are two hops apart; the chunk has no name."""
    found = traverse.entity_path(g.all_edges, g.nodes, *_two_names(g))
    return found.select("distance", F.array_join("path_nodes", "|", "").alias("path_nodes"), F.array_join("relations", "|").alias("relations"))


@query(f"SELECT DISTINCT type, doc_id, title FROM en JOIN c USING (chunk_id) JOIN (SELECT doc_id, title FROM d) USING (doc_id) WHERE name = {_TOP_NAME}")
def entity_documents(g):
    return traverse.entity_documents(g.mentions, g.chunks, g.documents, _top_name(g))


_HYBRID = """, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
gs AS (SELECT chunk_id, row_number() OVER (ORDER BY match_count DESC, chunk_index, chunk_id) AS gr FROM (SELECT chunk_id, chunk_index, match_count FROM (SELECT chunk_id, count(DISTINCT term) AS match_count FROM en, (SELECT unnest(['then', 'ation']) AS term) WHERE contains(name, term) GROUP BY chunk_id) JOIN c USING (chunk_id) WHERE active ORDER BY match_count DESC, chunk_index, chunk_id LIMIT 8)),
vs AS (SELECT chunk_id, vs, row_number() OVER (ORDER BY vs DESC, chunk_id) AS vr FROM (SELECT printf('doc_%03d_c000', vec_id) AS chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) AS vs FROM embeddings ORDER BY vs DESC, chunk_id LIMIT 6) JOIN (SELECT chunk_id FROM c WHERE active) USING (chunk_id)),
fu AS (SELECT chunk_id, gr IS NOT NULL AS has_graph, coalesce(CASE WHEN vs IS NULL THEN NULL WHEN max(vs) OVER () = min(vs) OVER () THEN 1.0 ELSE (vs - min(vs) OVER ()) / (max(vs) OVER () - min(vs) OVER ()) END, 0) AS vn, coalesce(1.0 / (60 + gr), 0) + coalesce(1.0 / (60 + vr), 0) AS rrf FROM gs FULL JOIN vs USING (chunk_id)),
se AS (SELECT *, CASE WHEN max(rrf) OVER () = min(rrf) OVER () THEN 1.0 ELSE (rrf - min(rrf) OVER ()) / (max(rrf) OVER () - min(rrf) OVER ()) END AS rn FROM fu),
two AS (SELECT src AS a, dst AS b FROM ae UNION ALL SELECT dst, src FROM ae), r(id, depth) AS (SELECT chunk_id, 0 FROM se UNION SELECT two.b, r.depth + 1 FROM r JOIN two ON r.id = two.a WHERE r.depth < 2),
near AS (SELECT id, label, depth FROM (SELECT id, min(depth) AS depth FROM r GROUP BY id) JOIN (SELECT id, label FROM an) USING (id) ORDER BY depth, label, id LIMIT 50),
ch AS (SELECT * FROM c WHERE chunk_id IN (SELECT id FROM near WHERE label = 'Chunk' UNION SELECT chunk_id FROM se)) """
_TERMS = ["then", "ation"]


def _graph(g) -> answer.Tables:
    return answer.Tables(g.documents, g.chunks, g.mentions, g.tags, g.vectors, g.nodes, g.all_edges)


def _hybrid(g) -> answer.Retrieved:
    return answer.retrieve(_graph(g), _TERMS, [float(x) for x in _vector(g)])


@query(_HYBRID + "SELECT chunk_id, has_graph, round(rrf + 0.15 * vn, 6) AS merge_score FROM se", GRAPH_SQL)
def hybrid_seeds(g):
    """Seeds by name and by vector, fused."""
    return answer.merged_seeds(_graph(g), _TERMS, [float(x) for x in _vector(g)]).select("chunk_id", "has_graph", F.round("merge_score", 6).alias("merge_score"))


@query(_HYBRID + """SELECT chunk_id, is_seed, retrieval_score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY is_seed ORDER BY retrieval_score DESC, chunk_id DESC) AS place FROM (SELECT chunk_id, se.chunk_id IS NOT NULL AS is_seed,
round(0.55 * coalesce(vn, 0) + 0.25 * greatest(CASE WHEN has_graph THEN 1.0 ELSE 0.0 END, coalesce(rn, 0)) + 0.2 * ((CAST(contains(lower(text), 'then') AS INT) + CAST(contains(lower(text), 'ation') AS INT)) / 2) + (CASE WHEN se.chunk_id IS NOT NULL THEN 0.1 ELSE 0 END), 6) AS retrieval_score FROM ch LEFT JOIN se USING (chunk_id))) WHERE place <= (CASE WHEN is_seed THEN 16 ELSE 24 END)""", GRAPH_SQL)
def hybrid_context(g):
    """The whole chain up to the re-ranked chunks."""
    return _hybrid(g).chunks.select("chunk_id", "is_seed", "retrieval_score", "place")


@query(_HYBRID + "SELECT 'document' AS kind, doc_id AS id FROM ch UNION SELECT 'tag', substr(id, 3) FROM near WHERE label = 'Tag' UNION SELECT 'entity', substr(id, 3) FROM near WHERE label = 'Entity' UNION SELECT 'faq', id FROM near WHERE label = 'FAQ'", GRAPH_SQL)
def context_items(g):
    """Documents, tags, entities and FAQs of a context."""
    found = _hybrid(g)
    parts = [("document", found.documents, F.col("doc_id")), ("tag", found.tags, F.col("tag")), ("entity", found.entities, F.concat("type", F.lit("|"), "name")), ("faq", found.faqs, F.col("faq_id"))]
    rows = [df.select(F.lit(kind).alias("kind"), key.alias("id")) for kind, df, key in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("SELECT chunk_id, doc_id, CASE WHEN number % 2 = 0 THEN reverse(text) ELSE text END AS text, CAST(chunk_index AS INTEGER) AS chunk_index FROM (SELECT chunk_id, doc_id, text, chunk_index, active FROM c) JOIN (SELECT doc_id, number FROM d) USING (doc_id) WHERE number % 3 <> 0 OR number % 2 = 0")
def upsert_chunks(g):
    """Two thirds of the chunks are there; those of even documents come again, some new, some with another text, and some of documents that don't exist."""
    chunks = g.chunks.join(g.documents.select("doc_id", "number"), "doc_id")
    old = chunks.where("number % 3 <> 0").select("chunk_id", "doc_id", "text", "chunk_index")
    new = chunks.where("number % 2 = 0").select("chunk_id", "doc_id", F.reverse("text").alias("text"), "chunk_index")
    lost = new.select(F.concat("chunk_id", F.lit("_lost")).alias("chunk_id"), F.concat("doc_id", F.lit("_lost")).alias("doc_id"), "text", "chunk_index")
    return writes.upsert_chunks(g.documents, old, g.edges.where("false"), new.unionByName(lost), AS_OF)[0]


@query("SELECT chunk_id, CASE WHEN vec_id % 2 = 0 THEN len(embedding) END AS embedding_dim, CASE WHEN vec_id % 2 = 0 THEN 'table' END AS embedding_model FROM c LEFT JOIN (SELECT printf('doc_%03d_c000', vec_id) AS chunk_id, vec_id, embedding FROM embeddings) USING (chunk_id)")
def upsert_embeddings(g):
    """Vectors of chunks that exist; empty ones change nothing."""
    chunks = g.chunks.select("chunk_id", F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model"), F.lit(None).cast("int").alias("embedding_dim"))
    even = F.regexp_extract("chunk_id", r"^doc_(\d+)_", 1).cast("long") % 2 == 0
    new = g.vectors.withColumn("embedding", F.when(even, F.col("embedding")).otherwise(F.array().cast("array<double>")))
    return writes.upsert_embeddings(chunks, new, "table", AS_OF).select("chunk_id", F.col("embedding_dim").cast("long").alias("embedding_dim"), "embedding_model")


@query("SELECT chunk_id FROM c WHERE chunk_id NOT IN (SELECT printf('doc_%03d_c000', vec_id) FROM embeddings WHERE vec_id % 2 = 0)")
def unembedded_chunks(g):
    even = F.regexp_extract("chunk_id", r"^doc_(\d+)_", 1).cast("long") % 2 == 0
    done = g.vectors.withColumn("embedding_model", F.when(even, "table").otherwise("other"))
    return search.unembedded(g.chunks, done, "table").select("chunk_id")


@query("SELECT DISTINCT 'HAS_TAG' AS type, chunk_id AS src, 't:' || tag AS dst FROM tg")
def upsert_tags(g):
    """Tags as people write them come into one form."""
    raw = g.tags.select(F.col("chunk_id").alias("owner"), F.concat(F.lit("  "), F.translate("tag", "abcdefghij", "ABCDEFGHIJ"), F.lit(" \n")).alias("tag"))
    lost = g.spark.createDataFrame([("nowhere", "tag"), ("doc_001_c000", "  ")], "owner string, tag string")
    return writes.upsert_tags(g.spark.createDataFrame([], "name string"), g.edges.where("false"), raw.unionByName(lost), g.chunks.select(F.col("chunk_id").alias("id")))[1].select("type", "src", "dst")


@query("SELECT DISTINCT name, type FROM (SELECT name, CASE WHEN place = 1 THEN 'UNKNOWN' ELSE type END AS type FROM en)")
def upsert_entities(g):
    raw = g.mentions.select(F.col("chunk_id").alias("owner"), F.concat(F.lit(" "), "name").alias("name"), F.when(F.col("place") == 1, " ").otherwise(F.lower("type")).alias("type"))
    none = g.spark.createDataFrame([], "name string, type string, active boolean, created_at timestamp, updated_at timestamp")
    return writes.upsert_entities(none, g.edges.where("false"), raw, g.chunks.select(F.col("chunk_id").alias("id")), AS_OF)[0].select("name", "type")


@query("""SELECT source, 'UNKNOWN' AS source_type, CASE WHEN t IN ('RELATED_TO', 'USES', 'PART_OF') THEN t ELSE 'RELATED_TO' END AS type, target, 'WORD' AS target_type, '7' AS weight, min(CASE WHEN t NOT IN ('RELATED_TO', 'USES', 'PART_OF') THEN raw_type END) AS raw_type FROM (SELECT *, replace(upper(raw_type), ' ', '_') AS t FROM rel) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6"))
def upsert_relationships(g):
    """Given by other names of the keys; properties stay, and the type as given where it isn't allowed."""
    raw = F.create_map(F.lit("from"), F.col("source"), F.lit("target"), F.concat(F.lit(" "), "target"), F.lit("relation"), F.col("raw_type"), F.lit("targetType"), F.lit("word"), F.lit("weight"), F.lit("7"))
    entities = g.spark.createDataFrame([], "name string, type string, active boolean, created_at timestamp, updated_at timestamp")
    relations = g.spark.createDataFrame([], "source string, source_type string, type string, target string, target_type string, props map<string,string>, updated_at timestamp")
    made = writes.upsert_relationships(entities, relations, g.relations.select(raw.alias("raw")), AS_OF)[1]
    return made.select("source", "source_type", "type", "target", "target_type", F.try_element_at("props", F.lit("weight")).alias("weight"), F.try_element_at("props", F.lit("raw_type")).alias("raw_type"))


@query("SELECT DISTINCT src, 'REFERS_TO' AS type, dst FROM e WHERE type = 'REFERS_TO'")
def link_refs(g):
    """References to documents that don't exist are left out."""
    refs = g.edges.where("type = 'REFERS_TO'").select("src", "dst")
    lost = refs.select("src", F.concat("dst", F.lit("_lost")).alias("dst"))
    return writes.link_refs(g.documents, g.edges.where("false"), refs.unionByName(lost)).select("src", "type", "dst")


@query("SELECT faq_id AS src, 'DERIVED_FROM' AS type, chunk_id AS dst FROM f WHERE chunk_id IN (SELECT chunk_id FROM c)", GRAPH_SQL)
def faq_links(g):
    return writes.link_faqs(g.faqs, g.chunks, g.edges.where("false"), g.faqs.select("faq_id", "chunk_id")).select("src", "type", "dst")


@query("SELECT chunk_id, count(*) AS entities, string_agg(type || '|' || name, ',' ORDER BY place) AS listed FROM en GROUP BY chunk_id")
def annotation_roundtrip(g):
    """Annotations written as JSON and read again, malformed entries left out."""
    own = g.mentions.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("place", "name", "type"))).alias("e"))
    entities = F.transform("e", lambda x: F.struct(x["name"].alias("name"), F.concat(F.lit(" "), F.lower(x["type"])).alias("type")))
    more = F.array_append(entities, F.struct(F.lit(" ").alias("name"), F.lit("x").alias("type")))
    read = own.select("chunk_id", read_annotation(annotation_json(more)).alias("a"))
    return read.select("chunk_id", F.size("a.entities").cast("long").alias("entities"), F.array_join(F.transform("a.entities", lambda x: F.concat(x["type"], F.lit("|"), x["name"])), ",").alias("listed"))


@query("SELECT item_id, array_to_string(list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1]), '|') AS terms FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-zа-яёіїє0-9]+'), lambda x: length(x) > 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in tx.WEB_STOPWORDS) + ")) AS t FROM benchmark)")
def web_terms(g):
    return g.table("benchmark").select("item_id", F.array_join(tx.web_terms(F.col("text")), "|").alias("terms"))


from . import retrieval  # noqa: E402, F401 registers more queries
