from weftgraph.buckets import BucketTable
from weftgraph.functions import text as tx
from weftgraph.streaming import chunk_changes, keep_chunks

from pyspark.sql import functions as F

SCHEMA = "doc_id string, version long, text string, digest string"


def fresh(spark, rows):
    """Chunks of the newest versions, cut anew."""
    newest = {}
    for doc, version, text, _ in rows:
        if doc is not None and version is not None:
            newest[doc] = max(newest.get(doc, (-1, "")), (version, text or ""))
    table = spark.createDataFrame([(d, t) for d, (_, t) in newest.items()], "doc_id string, text string")
    cut = table.select("doc_id", F.explode(tx.windows(F.trim("text"))).alias("w"))
    return sorted((f"{r.doc_id}_c{r.w["index"]:03d}", r.w["text"]) for r in cut.collect())


def test_replay_is_like_a_fresh_ingest(spark, tmp_path):
    """Versions in any order, shrinking and growing, twice, empty and null: the table is that of the newest versions."""
    long = "".join(chr(97 + i % 26) * 10 for i in range(500))
    batches = [
        [("a", 1, long, "x"), ("b", 1, "short", "x"), ("c", 5, long[:2500], "x"), (None, 1, "no key", "x"), ("n", None, "no version", "x")],
        [("a", 2, long[:1500], "x"), ("b", 2, long[::-1], "x"), ("b", 2, long[::-1], "x"), ("c", 4, "late", "x"), ("d", 1, None, "x")],
        [("a", 3, long[:1500] + "more" * 400, "x"), ("b", 3, "", "x"), ("c", 6, long[:2500], "x"), ("d", 1, "", "x"), ("a", 2, "old", "x")],
    ]
    landing, table = f"file://{tmp_path}/landing", BucketTable(spark, f"file://{tmp_path}/chunks", ["chunk_id"], "chunk_id string, doc_id string, chunk_index int, text string, created_at timestamp, updated_at timestamp", 4)
    seen = []
    for i, batch in enumerate(batches):
        seen += batch
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(SCHEMA).parquet(landing)
        keep_chunks(chunk_changes(stream), table, f"file://{tmp_path}/checkpoint", f"2024-01-0{i + 1}").awaitTermination()
        assert sorted((r.chunk_id, r.text) for r in table.read().collect()) == fresh(spark, seen)
    told = {r.chunk_id: r.updated_at.day for r in table.read().collect()}
    assert told["a_c000"] == 1 and told["a_c001"] == 3 and told["c_c000"] == 1  # unchanged chunks were not written again
