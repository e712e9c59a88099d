import re

import pytest

from weftgraph.llm import jaccard_join as jj

from test_jaccard_join import chains


def slow(rows, percent, size):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    of = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if of[i] != of[j] and a and b and 100 * len(a & b) >= percent * len(a | b):
                of = [of[j] if x == of[i] else x for x in of]
    least = {}
    for group, (doc_id, _) in zip(of, rows, strict=True):
        least[group] = min(doc_id, least.get(group, doc_id))
    return sorted((doc_id, len(s), least[group]) for group, s, (doc_id, _) in zip(of, sets, rows, strict=True))


@pytest.mark.parametrize("seed,boundary", [(6, None), (7, 0), (8, 1000)])
def test_five_words_and_eighty_percent(spark, seed, boundary, monkeypatch):
    """The rule of the pipeline's stage, against brute force; small sets of each size are near its edge."""
    if boundary is not None:
        monkeypatch.setattr(jj, "choose_boundary", lambda *_: boundary)
    rows = chains(seed, 110)
    edge = [(10_000 + 10 * n + k, " ".join(f"s{n}x{i}" for i in range(n + k))) for n in range(3, 14) for k in range(3)]
    rows = rows + edge
    got = jj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 80, 5)
    assert sorted(map(tuple, got.collect())) == slow(rows, 80, 5)


def test_pipeline_links_from_eighty_percent(spark):
    import corpus_pipeline as cp

    # 100 words of which two, well apart, or six adjoining ones differ: 86/106 of five words, 89/105 and 88/106 of four.
    words = [f"w{i}" for i in range(100)]
    apart = [f"x{i}" if i in (30, 70) else w for i, w in enumerate(words)]
    other = [f"o{i}" for i in range(100)]
    block = [f"y{i}" if 40 <= i < 46 else w for i, w in enumerate(other)]
    rows = [(i, " ".join(w)) for i, w in enumerate([words, apart, other, block], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()) == [1, 3]
    assert sorted(r.doc_id for r in jj.keep_one(docs).collect()) == [1, 2, 3, 4]


def test_null_and_reused_ids(spark):
    """A row goes only if a row that it links with stays."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    near = {k: t + " more" for k, t in text.items()}
    stay = [(None, text["a"], "x"), (1, text["b"], "x"), (5, text["c"], "x"), (5, text["d"], "x"), (7, None, "x"), (None, None, "x"), (None, "", "x"), (None, " ", "y"), (9, text["f"], "x")]
    go = [(None, near["b"], "x"), (6, near["c"], "x"), (6, near["d"], "x"), (None, near["d"], "x"), (7, None, "x"), (None, " ", "y"), (9, text["f"], "x")]
    twice = [(None, text["g"], "x"), (None, text["g"], "x")]
    docs = spark.createDataFrame(stay + go + twice, "doc_id long, text string, source string").repartition(3)
    order = lambda r: tuple((v is not None, v) for v in r)
    got = sorted(map(tuple, jj.keep_one(docs, 80, 5).collect()), key=order)
    assert got == sorted(stay + twice[:1], key=order)
