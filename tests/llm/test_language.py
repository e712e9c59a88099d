from zlib import crc32

import numpy as np

from weftgraph.llm import language as la


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = la.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_spans_of_mixed_text(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = la.fit(documents)
    rows = documents.where("n_chars between 800 and 2000").orderBy("doc_id").collect()
    en = next(r.text for r in rows if r.lang == "en")
    de = next(r.text for r in rows if r.lang == "de")
    langs, shares, spans = la.label([en + " " + de], model)
    assert [s["lang"] for s in spans[0]] == ["en", "de"]
    assert abs(spans[0][1]["start"] - len(en)) < 40
    assert 0.2 < shares[0] < 0.9


def slow_viterbi(scores, switch):
    best = [(0.0, [])] * scores.shape[1]
    v = [(s, [i]) for i, s in enumerate(scores[0])]
    for row in scores[1:]:
        v = [max(((b - (0 if j == i else switch)) + row[i], path + [i]) for j, (b, path) in enumerate(v)) for i in range(len(row))]
    del best
    return max(v)


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(3)
    counts = np.array([5, 1, 9, 0, 30])
    scores = rng.normal(0, 3, (counts.sum(), 3)).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    got = la.viterbi(scores, first, counts, 2.0)
    for f, n in zip(first, counts, strict=True):
        if n:
            own = scores[f : f + n].astype(float)
            path = got[f : f + n]
            total = own[np.arange(n), path].sum() - 2.0 * (path[1:] != path[:-1]).sum()
            assert abs(total - slow_viterbi(own, 2.0)[0]) < 1e-3


def test_scripts_narrow(spark):
    rows = [(i, "привет мир как дела сегодня " * 5, "ru") for i in range(40)] + [(i, "hello world how are you today " * 5, "en") for i in range(40, 80)]
    model = la.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs, _, spans = la.label(["zzz привет", "qwertz asdf", "12 34", "", "漢字"], model)
    assert langs[1] == "en" and langs[2:4] == ["und", "und"]
    assert {s["lang"] for s in spans[0]} <= {"ru", "en"} and langs[4] in ("en", "ru")


def test_edges(docs, nothing, small):
    got = {r.doc_id: r for r in la.identify(docs).collect()}
    for doc_id, text, *_ in small:
        if not any(c.isalpha() for c in text or ""):
            assert (got[doc_id].lang_pred, got[doc_id].score, got[doc_id].spans) == ("und", 0.0, [])
    assert got[3].lang_pred == "fr" and got[1].lang_pred == "en"
    assert la.identify(nothing).count() == 0
    assert la.keep_identified(docs).columns == docs.columns
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in la.identify(unlabelled).collect()} == {"und"}


def test_rare_languages_are_learned(spark, monkeypatch):
    """All of 300 languages, and words scored in several blocks."""
    def text(k):
        return " ".join(chr(97 + k // 26) + chr(97 + k % 26) + x for x in ("kmo", "vut", "zzi", "ploq", "hyrr")) * 8

    rows = [(k * 10 + i, text(k), f"l{k:03}") for k in range(300) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = la.fit(frame)
    assert len(model.languages) == 300 and model.logs.size <= 256 << la.BITS
    whole = la.label([text(299) + " " + text(0)], model)
    monkeypatch.setattr(la, "SLOT_SCORES", 5_000)
    assert la.label([text(299) + " " + text(0)], model) == whole
    assert np.mean([la.label([text(k)], model)[0] == [f"l{k:03}"] for k in range(300)]) > 0.9
