import re

import numpy as np

from weftgraph.llm import quality as q


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_statistics(docs, small, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.n_words): r for r in q.assess(docs, none).collect()}
    for doc_id, text, *_ in small:
        if text and len(text) > 10_000:
            continue
        s = slow(text)
        r = got[doc_id, s[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert r.kept == (not r.base_failed)


def test_windows_and_lines():
    assert q.repeated_words(b"a a a a a".split()) == 5
    assert q.repeated_words(b"a b c d a b c".split()) == 6
    assert q.base_statistics("x y\n\nx y\n x y\n \n \nx y")[3] == 2


def test_learns_and_is_calibrated(spark):
    sf = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = q.fit(documents, labels)
    rows = labels.join(documents, "doc_id").select("text", "quality").orderBy("doc_id").limit(1200).collect()
    p = model.probabilities([r.text for r in rows])
    y = np.array([r.quality for r in rows])
    assert ((p >= 0.5) == y).mean() > 0.95
    assert abs(p.mean() - y.mean()) < 0.05


def test_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (10, 0, 0), (None, 1, 1), (3, 1, 0), (13, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert q.assess(docs, labels).count() == docs.count()
    assert q.assess(nothing, labels).count() == 0
    assert q.keep_good(docs, labels.limit(0)).columns == docs.columns
