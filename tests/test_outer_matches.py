from pyspark.sql import functions as F

from weftgraph.operators import kb, traverse


def test_predicate_narrows_the_match_not_the_rows(spark):
    documents = spark.createDataFrame([("a", "The Thing"), ("b", "other"), ("c", None), ("d", "no chunk")], "doc_id string, title string")
    chunks = spark.createDataFrame([("a0", "a", "x"), ("b0", "b", "some THING"), ("b1", "b", None), ("c0", "c", "y")], "chunk_id string, doc_id string, text string")
    tags = spark.createDataFrame([("a0", "p"), ("a0", "q"), ("b0", "p"), ("b1", "something"), ("b1", "p"), ("c0", None)], "chunk_id string, tag string")
    got = {r.doc_id: (r.n_chunks, r.n_matches) for r in kb.topic_matches(documents, chunks, tags, " thing ").collect()}
    assert got == {"a": (1, 2), "b": (2, 2), "c": (1, 0), "d": (0, 0)}
    assert kb.topic_matches(documents.limit(0), chunks, tags, "thing").count() == 0


def test_first_of_each(spark):
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "y"), (None, 0, "n"), ("m", 5, None)], "key string, place int, v string")
    got = traverse.first_of_each(rows, "key", "place")
    assert got.columns == rows.columns
    assert sorted(map(tuple, got.collect())) == [("k", 1, "y"), ("m", 5, None)]
    assert traverse.first_of_each(rows.where(F.lit(False)), "key", "place").count() == 0
