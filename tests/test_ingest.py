import json

import pytest
from pyspark.sql import functions as F

from weftgraph import ingest, storage
from weftgraph.functions.text import relationship, without_nulls
from weftgraph.operators import answer, kb, search, traverse, vector_index, writes
from weftgraph.sources import read_annotation, read_files, read_manifest, with_texts, write_manifest

AS_OF = "2024-06-01 00:00:00"


def counting(mark):
    class Counting:
        """Annotates with a mark that says which run it was."""

        def annotate(self, texts):
            return [{"tags": [mark, " Tag  One "], "entities": [{"name": "Kafka"}, {"name": " "}], "relationships": [{"from": "Kafka", "to": "Broker", "type": "sits near"}]} for _ in texts]

    return Counting()


@pytest.fixture
def manifest(spark, tmp_path):
    (tmp_path / "my [file].txt").write_text("first text " * 200)
    (tmp_path / "empty.txt").write_text(" ")
    (tmp_path / "m.json").write_text(json.dumps([{"title": "a", "file_path": "my [file].txt", "keywords": ["K"]}, {"title": "b", "file_path": "empty.txt", "description": "second text"}, {"title": "c", "file_path": str(tmp_path / "none.txt"), "description": "third text"}]))
    return with_texts(read_manifest(spark, str(tmp_path / "m.json")), read_files(spark, f"{tmp_path}"), str(tmp_path))


def test_texts_and_fallback(manifest):
    got = {r.title: r.text for r in manifest.collect()}
    assert got == {"a": "first text " * 200, "b": "second text", "c": "third text"}


def test_ingest_reads_and_writes_the_cache(spark, manifest, tmp_path):
    cache = str(tmp_path / "cache")
    g = ingest.ingest(manifest, cache, AS_OF, counting("one"))
    assert g["chunks"].count() == 4 and g["edges"].where("type = 'CONTAINS'").count() == 4
    assert {r.name for r in g["tags"].collect()} == {"one", "tag one"}
    assert {(r.name, r.type) for r in g["entities"].collect()} == {("Kafka", "OTHER"), ("Kafka", "UNKNOWN"), ("Broker", "UNKNOWN")}
    assert [(r.type, r.props) for r in g["relations"].collect()] == [("RELATED_TO", {"raw_type": "sits near"})]
    # Only what changed is annotated anew; other settings make all new.
    changed = manifest.withColumn("text", F.when(F.col("title") == "b", F.lit("other text")).otherwise(F.col("text")))
    again = ingest.ingest(changed, cache, AS_OF, counting("two"))
    assert sorted(r["count"] for r in again["edges"].where("dst in ('t:one', 't:two')").groupBy("dst").count().collect()) == [1, 3]
    assert {r.name for r in ingest.ingest(changed, cache, AS_OF, counting("three"), 600, 100)["tags"].collect()} == {"three", "tag one"}
    assert storage.load_version(spark, cache, ingest.CACHE).count() == 7
    assert ingest.ingest(manifest.where("false"), str(tmp_path / "none"), AS_OF)["chunks"].count() == 0


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert storage.load_version(spark, path, "a int").count() == 0
    storage.save_version(spark.createDataFrame([(1,)], "a int"), path)
    storage.save_version(storage.load_version(spark, path, "a int").selectExpr("a + 1 as a"), path)
    assert storage.load_version(spark, path, "a int").collect()[0].a == 2
    (tmp_path / "t" / "v3").mkdir()  # begun, never finished
    assert storage.load_version(spark, path, "a int").collect()[0].a == 2
    assert storage.load_version(spark, path, "b string").count() == 0
    assert storage.run_sql(spark, "SELECT :x + 1 AS y", x=1).first().y == 2


def test_manifest_round_trip(spark, tmp_path, manifest):
    write_manifest(manifest, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 3 and set(back.columns) >= {"title", "file_path"}


def test_prompted():
    answers = iter(['so {"entities": [{"name": "A", "type": "x"}, 3], "relationships": [{"source": "A"}, {"source": "A", "target": "B"}]}', "no", '{"keywords": ["K  k", "k K", "", 4, "z"]}', "no", "none"])
    made = ingest.Prompted(lambda _: next(answers))
    (got,) = made.annotate(["text"])
    assert got["entities"] == [{"name": "A", "type": "X"}] and got["relationships"] == [{"source": "A", "target": "B", "type": "RELATED_TO"}] and got["tags"] == ["K k", "z"]
    assert made.query_entities("q") is None


def test_embedding_falls_back(spark):
    class Broken:
        model = "broken"

        def embed(self, texts):
            return [[0.0]] if len(texts) < 16 else [[float(len(t))] for t in texts]

    class Ones(Broken):
        model = "ones"

        def embed(self, texts):
            return [[1.0, 2.0] for _ in texts]

    chunks = spark.range(20).selectExpr("concat('c', id) as chunk_id", "concat(' a  b', id) as text").coalesce(1)
    got = ingest.embedded(chunks, Broken(), Ones()).groupBy("embedding_model").count().collect()
    assert {r.embedding_model: r["count"] for r in got} == {"broken": 16, "ones": 4}


def test_annotations_and_maps(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    got = one(read_annotation(F.lit('{"entities": [{"name": " A "}, {"type": "X"}, null], "tags": ["t", null]}')))
    assert ([tuple(e) for e in got.entities], got.tags, got.relationships, got.chunk_type) == ([("A", "OTHER")], ["t"], [], "other")
    made = lambda **m: one(relationship(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])))
    assert made(source=" ", target="b") is None
    got = made(**{"from": "a", "target": " b ", "relation": "part of", "sourceType": "x", "w": "1"})
    assert (got.source, got.source_type, got.target, got.target_type, got.type, got.props) == ("a", "X", "b", "UNKNOWN", "PART_OF", {"w": "1"})
    assert one(without_nulls(F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("1")))) == {"b": "1"}


def test_writes_keep_their_rules(spark):
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    edges = spark.createDataFrame([], "src string, type string, dst string")
    assert [r.dst for r in writes.link_refs(docs, edges, spark.createDataFrame([("d1", "d2"), ("d1", "zz"), ("d1", "d2")], "src string, dst string")).collect()] == ["d2"]
    old = spark.createDataFrame([("d1", "old")], "doc_id string, title string")
    new = spark.createDataFrame([("d1", "b", 2), ("d1", "c", 1), ("d3", "x", 1)], "doc_id string, title string, n int")
    assert {tuple(r) for r in writes.upsert(old, new, ["doc_id"], AS_OF, order="n").collect()} == {("d1", "b"), ("d3", "x")}
    assert {tuple(r) for r in writes.upsert(old, new.drop("n"), ["doc_id"], AS_OF).collect()} == {("d1", "c"), ("d3", "x")}
    bad = spark.createDataFrame([("a",), ("a",), (None,)], "doc_id string")
    assert {r.doc_id for r in writes.doubled_keys(bad, ["doc_id"]).collect()} == {"a", None} and writes.cleared({"d": docs})["d"].count() == 0
    with pytest.raises(ValueError):
        writes.link_similarities(docs, docs, docs, "Tag", AS_OF)
    relations = spark.createDataFrame([("a", "UNKNOWN", "USES", "b", "UNKNOWN", {"w": "1", "k": "x"}, None)], "source string, source_type string, type string, target string, target_type string, props map<string,string>, updated_at timestamp")
    entities = spark.createDataFrame([], "name string, type string, active boolean")
    raw = spark.createDataFrame([({"source": "a", "target": "b", "type": "uses", "w": "2"},), ({"source": "a", "target": "b", "type": "uses", "z": "3"},)], "raw map<string,string>")
    _, made = writes.upsert_relationships(entities, relations, raw, AS_OF)
    assert [r.props for r in made.collect()] == [{"w": "2", "k": "x", "z": "3"}]
    for record in ([("", "t")], [(None, "t")]):
        with pytest.raises(Exception, match="file_path"):
            kb.normalised(spark.createDataFrame(record, "file_path string, title string").withColumn("description", F.lit("")).withColumn("keywords", F.array().cast("array<string>"))).collect()
    for bad_index in ((0,), (3, "dot"), (3, "cosine", "a-b")):
        with pytest.raises(ValueError):
            search.check_index(*bad_index)


def test_similar_pairs(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.01 * i, 0.0] if i < 4 else [0.0, 0.0, float(i)]) for i in range(6)], "id long, v array<double>")
    got = {(r.src, r.dst) for r in vector_index.similar_pairs(rows, "id", "v", 3, 0.99).collect()}
    assert got == {(a, b) for a in range(4) for b in range(a + 1, 4)} | {(4, 5)}


@pytest.fixture(scope="module")
def tables(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return answer.Tables(
        documents=frame([("d1", "On Kafka", "about brokers"), ("d2", "Other", "x")], "doc_id string, title string, text string"),
        chunks=frame([("c1", "d1", 0, "kafka has brokers", True), ("c2", "d1", 1, "brokers keep logs", None), ("c3", "d2", 0, "nothing here", False)], "chunk_id string, doc_id string, chunk_index int, text string, active boolean"),
        mentions=frame([("c1", "Kafka", "TECH"), ("c2", "Broker", "TECH")], "chunk_id string, name string, type string"),
        tags=frame([("c2", "logs")], "chunk_id string, tag string"),
        vectors=frame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0]), ("c3", [1.0, 0.1])], "chunk_id string, embedding array<double>"),
        nodes=frame([("d1", "Document", None, None), ("d2", "Document", None, None), ("c1", "Chunk", None, None), ("c2", "Chunk", None, None), ("c3", "Chunk", None, None), ("e1", "Entity", "Kafka", "TECH"), ("e2", "Entity", "Broker", "TECH"), ("t1", "Tag", "logs", None)], "id string, label string, name string, type string").withColumn("question", F.lit(None).cast("string")).withColumn("answer", F.lit(None).cast("string")),
        edges=frame([("d1", "CONTAINS", "c1"), ("d1", "CONTAINS", "c2"), ("d2", "CONTAINS", "c3"), ("c1", "MENTIONS", "e1"), ("c2", "MENTIONS", "e2"), ("c2", "HAS_TAG", "t1")], "src string, type string, dst string"),
    )


def test_answer(tables):
    class Picky:
        def __init__(self):
            self.seen = []

        def generate_answer(self, question, context):
            self.seen.append(len(context))
            raise answer.TooLong

    got = answer.answer(tables, "kafka?", ["kafka"], [1.0, 0.0], more="outside", trace=True)
    assert "SEED CHUNKS:\n- chunk_id=c1" in got["answer"] and got["answer"].endswith("EXTERNAL TOOL CONTEXT:\noutside")
    assert [c["chunk_id"] for c in got["citations"]][0] == "c1" and got["trace"]["seeds"][0] == "c1" and got["trace"]["nodes"]["Chunk"] == 2
    none = answer.answer(tables, "zzz", ["zzz"])
    assert none["citations"] == [] and "No graph context found." in none["answer"]
    picky = Picky()
    with pytest.raises(answer.TooLong):
        answer.generate(picky, "q", "x" * 9000)
    assert len(picky.seen) == 6 and picky.seen[0] == 9000 and picky.seen[-1] < 100


def test_records_and_paths(tables):
    nodes, edges = traverse.as_records(tables.nodes, tables.edges, "name", "type")
    assert {r.id: r.properties for r in nodes.collect()}["e1"] == {"name": "Kafka", "type": "TECH"} and edges.count() == 6
    row = traverse.entity_path(tables.edges, tables.nodes, "Kafka", "Broker").first()
    assert (row.distance, row.path_nodes, row.relations) == (4, ["Kafka", None, None, None, "Broker"], ["MENTIONS", "CONTAINS", "CONTAINS", "MENTIONS"])
    assert traverse.entity_path(tables.edges, tables.nodes, "Kafka", "zzz").isEmpty()
    seeds = tables.nodes.where("id in ('c1', 'd1')").select("id")
    assert {r.id for r in traverse.subgraph(tables.edges, tables.nodes, seeds, 1, label="Document")[0].collect()} == {"d1", "c1", "c2"}
