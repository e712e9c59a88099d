import corpus_pipeline as cp
from weftgraph.llm import bpe
from weftgraph.llm.common import documents, stored
from weftgraph.llm.queries import queries


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in cp.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != "encode":
            assert docs.columns == columns and docs.exceptAll(docs.distinct()).count() == (0 if name != "mix_sources" else counts[-1] - docs.distinct().count())
            assert docs.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0 and counts[4] == counts[5]
    assert {r.doc_id: r.decoded for r in docs.collect()} == {r.doc_id: r.text for r in before.collect()}
    ids = docs.first().ids
    assert len(bpe.library(cp.vocabulary_path()).decode(list(memoryview(bytes(ids)).cast("I")))) > 0


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.where("quality = 1").join(docs, "doc_id").where("size(split(trim(text), '[ \\\\n]+')) >= 60").select(docs.columns)
    kept = cp.quality_rules(spark, docs, sf)
    kept_good = good.select("doc_id").distinct().join(kept.select("doc_id").distinct(), "doc_id").count()
    assert kept_good >= 0.97 * good.select("doc_id").distinct().count()
    assert cp.language_id(spark, good, sf).count() >= 0.99 * good.count()


def test_names():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]


def test_stages_on_awkward_rows(spark, docs, nothing, tmp_path):
    """Nulls, empty texts, repeats, reused ids and columns named as the operators' own: every stage runs and keeps the columns."""
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for c in ("block", "ids", "of", "copies", "slot", "key", "_row", "size"):
        docs = docs.withColumn(c, docs.doc_id.cast("string")) if c not in docs.columns else docs
    empty = docs.limit(0)
    null_rows = docs.where("doc_id = 1").selectExpr(*(f"if(doc_id = 1, null, `{c}`) as `{c}`" if c in ("doc_id", "source") else f"`{c}`" for c in docs.columns))
    for rows in (docs.unionByName(null_rows), empty):
        for name, stage in cp.STAGES:
            out = stage(spark, rows, str(tmp_path))
            if name != "encode":
                assert out.columns == rows.columns
            got = out.count()
            assert got <= 3 * rows.count() and (rows is not empty or got == 0)
