import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as tx
from weftgraph.functions.splitting import SEPARATORS, by_separators, by_tokens, spans
from weftgraph.operators import context

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", ["", "a", "x" * 95, "one two three. " * 20, "p\n\n" * 30 + "y" * 50 + "\n\nz", "\n\n\n\na b"])
def test_spans_cover_the_text(text):
    got = list(spans(text, 20, 5))
    assert all(0 < b - a <= 20 for a, b in got)
    assert {i for a, b in got for i in range(a, b)} == set(range(len(text)))
    assert all(a2 >= b1 - 5 and a2 > a1 for (a1, b1), (a2, _) in zip(got, got[1:], strict=False))


def test_spans_prefer_high_separators():
    text = "aaaa bbbb\n\ncccc dddd\n\neeee ffff gggg hhhh"
    assert [c for a, b in spans(text, 12, 0, SEPARATORS) if (c := text[a:b].strip())] == ["aaaa bbbb", "cccc dddd", "eeee ffff", "gggg hhhh"]


def test_splitters_on_rows(spark):
    rows = spark.createDataFrame([(1, "a b " * 30, 0), (1, "a b " * 30, 0), (2, None, 0), (3, "  ", 0)], "id int, text string, index int")
    got = by_separators(rows, "id", "text", 50, 10)
    assert {(r["id"], r["index"]) for r in got.collect()} == {(1, i) for i in range(3)} and got.count() == 6
    parts = by_tokens(rows.where("id = 1").limit(1), "id", "text", VOCABULARY, 10, 0).orderBy("index").collect()
    assert "".join(r.text for r in parts).replace(" ", "") == "ab" * 30
    assert by_separators(rows.where("false"), "id", "text").count() == 0


def test_search_entries(spark):
    one = lambda t: spark.range(1).select(tx.search_entries(F.lit(t)).alias("x")).first().x
    assert [tuple(r) for r in one("1. A\n URL: http://a.example/).\n Summary: s\n  t\n2. B\nURL: http://b.example\nSummary: u")] == [("A", "http://a.example/", "s t"), ("B", "http://b.example", "u")]
    assert one(None) == [] and one("no results") == []


def test_keyword_path(spark):
    nodes = spark.createDataFrame([("c1", "Chunk", None), ("e1", "Entity", "Kafka"), ("t1", "Tag", "kafka"), ("e2", "Entity", "Broker"), ("e3", "Entity", "Lonely")], "id string, label string, name string")
    edges = spark.createDataFrame([("c1", "e1"), ("c1", "e2"), ("t1", "c1")], "src string, dst string").withColumn("type", F.lit("X"))
    assert context.keyword_path(nodes, edges, ["kafka", "nothing", "brok"]) == (["Kafka", "Broker"], ["nothing"])
    assert context.keyword_path(nodes, edges, ["lonely"]) == (["Lonely"], [])
    assert context.keyword_path(nodes, edges, ["kafka", "lonely"]) == ([], [])
    assert context.keyword_path(nodes, edges, ["x1", "x2"]) == ([], ["x1", "x2"])


def test_render(spark):
    empty = lambda s: spark.createDataFrame([], s)
    chunks = "chunk_id string, doc_id string, text string, place int"
    none = context.render(empty("doc_id string, title string"), empty("tag string"), empty("name string, type string"), empty(chunks), empty(chunks), empty("question string, answer string"))
    assert none.first().context == "No graph context found."
    seeds = spark.createDataFrame([("c2", "d", "b\nb", 2), ("c1", "d", "a" * 900, 1)], chunks)
    got = context.render(spark.createDataFrame([("d", "T")], "doc_id string, title string"), spark.createDataFrame([("y",), ("x",)], "tag string"), empty("name string, type string"), seeds, empty(chunks), spark.createDataFrame([("q", "a")], "question string, answer string")).first().context
    assert got == f"DOCUMENTS:\n- T (doc_id=d)\n\nTAGS:\nx, y\n\nSEED CHUNKS:\n- chunk_id=c1 doc_id=d :: {'a' * 800}…\n- chunk_id=c2 doc_id=d :: b b\n\nFAQ (linked):\n- Q: q\n  A: a"


def test_merge(spark):
    got = spark.range(1).select(context.merge(F.lit("c"), F.lit("x" * 300), 100).alias("a"), context.merge(F.lit("c"), F.lit(" ")).alias("b")).first()
    assert got.a == "c\n\nEXTERNAL TOOL CONTEXT:\n" + "x" * 197 + "..." and got.b == "c"
