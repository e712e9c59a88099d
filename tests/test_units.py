import hashlib
import json
import math
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as tx
from weftgraph.functions.vectors import hash_embedding
from weftgraph.operators import kb, search, traverse, writes
from weftgraph.sources import read_files, read_manifest, worklist
from weftgraph.streaming import ingest


def test_windows_at_the_edges(spark):
    for n, want in ((0, 0), (1, 1), (1200, 1), (1201, 2), (2200, 2), (2201, 3)):
        got = spark.range(1).select(tx.windows(F.lit("x" * n)).alias("w")).first().w
        assert len(got) == want and (not n or got[-1]["index"] * 1000 + len(got[-1].text) == n)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.query_terms(F.lit("What about Été, the été и привет-мир?"))) == ["été", "привет-мир"]
    assert one(tx.query_terms(F.lit(" The "))) == ["the"] and one(tx.query_terms(F.lit(""))) == []
    assert one(tx.relation_type(F.lit(" part of "))) == "PART_OF" and one(tx.raw_relation_type(F.lit("near by"))) == "near by"
    assert one(tx.tag(F.lit("  A \n b "))) == "a b" and one(tx.tag(F.lit("  "))) is None
    assert one(tx.urls(F.lit('a "https://a.b/c?d" (http://x.y/z). https://a.b/c?d'))) == ["https://a.b/c?d", "http://x.y/z"]
    assert one(tx.rtf_text(F.lit(r"{\rtf1\b Hello\b0  {\*\x y}world}"))) == "Hello world"
    assert one(tx.without_think(F.lit("<think>a\nb</think>c\n\n\n\nd"))) == "c\n\nd"
    assert one(tx.url_score(F.array(F.lit("kyiv")), F.lit("Kyiv news"), F.lit(""), F.lit("https://unian.ua/x"))) == 4.5


def test_hash_embedding(spark):
    rows = [(1, "alpha beta alpha"), (2, "!!"), (3, "gamma")]
    got = {(r.k, r.dim): r.weight for r in hash_embedding(spark.createDataFrame(rows, "k long, t string"), "k", "t", 16).collect()}
    want = {}
    for k, t in rows:
        v = [0.0] * 16
        for w in re.findall(r"[\w-]+", t):
            h = int(hashlib.sha1(w.encode()).hexdigest(), 16)
            v[h % 16] += (1 if (h >> 1) & 1 else -1) * (1 + (h % 997) / 9970)
        norm = math.sqrt(sum(x * x for x in v))
        want |= {(k, i): x / norm for i, x in enumerate(v) if x} or {(k, 0): 0.0}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"title": "a", "file_path": "x y.txt", "keywords": ["K"]}, {"title": None}]))
    rows = read_manifest(spark, str(tmp_path / "m.json")).collect()
    assert [r.title for r in rows] == ["a", ""] and rows[0].doc_id == "doc:" + hashlib.sha1(b"x y.txt").hexdigest()[:12] and rows[1].keywords == []
    files = tmp_path / "f"
    files.mkdir()
    (files / "a.txt").write_bytes(b"ab\xff c")
    (files / "b.bin").write_bytes(b"?")
    (files / "c.docx").write_bytes(b"broken")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(files / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:t>one</w:t><w:tab/><w:t>two</w:t></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:document>')
    got = {r.path.rsplit("/", 1)[1]: r.text for r in read_files(spark, str(files)).collect()}
    assert got == {"a.txt": "ab c", "b.bin": "", "c.docx": "", "d.docx": "one\ttwo\nthree"}
    cache = spark.createDataFrame([("a", hashlib.sha1(b"t").hexdigest())], "key string, text_hash string")
    assert [r.key for r in worklist(spark.createDataFrame([("a", "t"), ("b", "t")], "key string, text string"), cache).collect()] == ["b"]


def test_paths_and_balls(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("x", "r", "x"), ("a", "s", "b"), ("d", "r", "e"), ("e", "r", "f"), ("f", "r", "g")], "src string, type string, dst string")
    assert traverse.shortest_path(e, "a", "c").first().nodes == ["a", "b", "c"]
    assert traverse.shortest_path(e, "a", "f").first().distance == 5
    assert traverse.shortest_path(e, "a", "g").isEmpty() and traverse.shortest_path(e, "a", "x").isEmpty()
    assert traverse.shortest_path(e, "a", "a").first().distance == 0
    ball = {r.id: r.depth for r in traverse.ball(e, spark.createDataFrame([("c",), ("c",), ("x",)], "id string"), 1).collect()}
    assert ball == {"c": 0, "x": 0, "b": 1, "d": 1}


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", False, None, None), (2, "b", None, None, None)], "id int, v string, active boolean, created_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([(1, None), (3, "c")], "id int, v string")
    got = {r.id: (r.v, r.active, r.created_at is not None, r.updated_at is not None) for r in writes.upsert(old, new, ["id"], "2024-01-01").collect()}
    assert got == {1: ("a", True, False, True), 2: ("b", None, False, False), 3: ("c", True, True, True)}
    docs = spark.createDataFrame([(1, None), (2, True)], "doc_id int, active boolean")
    chunks = spark.createDataFrame([(1, "c1", None), (2, "c2", None)], "doc_id int, chunk_id string, active boolean")
    faqs = spark.createDataFrame([("f1", True), ("f2", True)], "faq_id string, active boolean")
    derived = spark.createDataFrame([("f1", "c1"), ("f1", "c2"), ("f2", "c2")], "faq_id string, chunk_id string")
    d, c, f = writes.soft_delete(docs, chunks, faqs, derived, 1)
    assert {r.faq_id: r.active for r in f.collect()} == {"f1": False, "f2": True}
    assert {r.chunk_id: r.active for r in c.collect()} == {"c1": False, "c2": None} and {r.doc_id: r.active for r in d.collect()} == {1: False, 2: True}


def test_arguments(spark):
    with pytest.raises(ValueError):
        kb.by_keywords(None, None, [])
    with pytest.raises(ValueError):
        search.nearest(spark.range(1), "id", "id", [1.0], metric="other")


def test_stream(spark, tmp_path):
    landing, seen = tmp_path / "in", []
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:01:00"), (1, "b", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "doc_id long, text string, landed_at string").withColumn("landed_at", F.col("landed_at").cast("timestamp")).write.parquet(str(landing))
    q = ingest(spark, str(landing), "doc_id long, text string, landed_at timestamp", str(tmp_path / "cp"), lambda df, _: seen.extend(df.select("doc_id", "text").collect()))
    q.awaitTermination()
    assert sorted(map(tuple, seen)) == [(1, "a"), (1, "b")]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= entry.oracle_sql().keys()
    assert entry.entry(spark).count() == 12
