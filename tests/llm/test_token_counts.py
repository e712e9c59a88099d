import pytest

from weftgraph.llm import token_counts as tc
from weftgraph.llm.bpe import library
from weftgraph.llm.common import scratch
from weftgraph.llm.queries import vocabulary_path


def test_like_the_library(docs, small, nothing):
    path = vocabulary_path()
    tokenizer = library(path)
    want = []
    for doc_id, text, *_ in small:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 1024))
    assert sorted(map(tuple, tc.counted(docs, path).collect())) == sorted(want)
    assert tc.counted(nothing, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(table, name):
    path = vocabulary_path(name)
    got = {r.doc_id: r.n_tokens for r in tc.counted(table, path).collect()}
    rows = table.select("doc_id", "text").limit(20).collect()
    if name.endswith(".model"):
        import sentencepiece

        want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(r.text)) for r in rows]
    else:
        want = [len(library(path).encode(r.text, add_special_tokens=False).ids) for r in rows]
    assert [got[r.doc_id] for r in rows] == want


def test_cache_is_read_and_appended(spark, docs, small):
    path, cache = vocabulary_path(), scratch(spark, "cache")
    first = sorted(map(tuple, tc.count_tokens(docs, path, cache).collect()))
    stored = tc.cached(spark, cache)
    distinct = len({r[1] or "" for r in small})
    assert stored.count() == distinct
    more = docs.unionByName(spark.createDataFrame([(99, "a text not seen before", None, None, 1, "", 1)], docs.schema))
    again = sorted(map(tuple, tc.count_tokens(more, path, cache).collect()))
    assert [r for r in again if r[0] != 99] == first
    assert tc.cached(spark, cache).count() == distinct + 1
    # a stored count is used as it is, and a key stored twice does not double rows
    tc.cached(spark, cache).write.mode("append").parquet(cache)
    assert sorted(map(tuple, tc.count_tokens(more, path, cache).collect())) == again


def test_shared_ids_and_hot_contents(spark, monkeypatch):
    """Rows that share an id (null too) are fetched by their content; hot contents are encoded where they lie."""
    rows = [(None if i % 2 else 7, "a copy" if i % 3 == 0 else f"text {i}") for i in range(300)] + [(i, "a copy") for i in range(100, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path, tokenizer = vocabulary_path(), library(vocabulary_path())
    want = sorted((i, len(t), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in [(i or -1, t) for i, t in rows])
    for few, share in ((tc.FEW, tc.HOT_SHARE), (10, 5)):
        monkeypatch.setattr(tc, "FEW", few)
        monkeypatch.setattr(tc, "HOT_SHARE", share)
        cache = scratch(spark, "hot_cache")
        got = tc.count_tokens(docs, path, cache).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
        stored = tc.cached(spark, cache)
        assert stored.select("content").distinct().count() == len({t for _, t in rows})
        assert stored.count() <= len({t for _, t in rows}) + 8  # a hot content at most once a task more
