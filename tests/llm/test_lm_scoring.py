import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from weftgraph.llm import ctw
from weftgraph.llm import lm_scoring as lm


def slow_model(docs, depth):
    """Counts of (context, node) as dictionaries; the recursion as in the definition."""
    counts = {}
    for doc in docs:
        data = lm.END * depth + doc
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                context = data[i - d : i]
                for bit in range(8):
                    node = (context, bit, data[i] >> (8 - bit))
                    counts.setdefault(node, [0, 0])[(data[i] >> (7 - bit)) & 1] += 1
    kids = {}
    for context, bit, prefix in counts:
        if context:
            kids.setdefault((context[1:], bit, prefix), []).append((context, bit, prefix))

    def pe(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    pw, lam = {}, {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        own = pe(*counts[node])
        if len(node[0]) == depth:
            pw[node], lam[node] = own, 1.0
        else:
            pw[node] = np.logaddexp(own, sum(pw[k] for k in kids[node])) - math.log(2)
            lam[node] = math.exp(own - math.log(2) - pw[node])
    return counts, lam


def slow_log2(model, doc, depth):
    counts, lam = model
    data = lm.END * depth + doc
    total = 0.0
    for i in range(depth, len(data)):
        for bit in range(8):
            one = (data[i] >> (7 - bit)) & 1
            p, known = 0.5, False
            for d in range(depth, -1, -1):
                node = (data[i - d : i], bit, data[i] >> (8 - bit))
                if node in counts:
                    a, b = counts[node]
                    kt = ((b if one else a) + 0.5) / (a + b + 1)
                    w = lam[node] if known else 1.0
                    p, known = w * kt + (1 - w) * p, True
            total += math.log2(p)
    return total


def normal(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, " ".join(words).encode() + b"\n"


def check(frame, rows):
    held = {i: i is not None and crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    train = [normal(t) for i, t in rows if not held[i]]
    counts = Counter(w for words, _ in train for w in [*words, "\n"])
    n, v = sum(counts.values()), len(counts)
    model = slow_model([d for _, d in train], lm.DEPTH)
    got = sorted(lm.score(frame).collect(), key=lambda r: (r.doc_id, r.score))
    want = []
    for i, t in rows:
        words, doc = normal(t)
        tokens = [*words, "\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((i, held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n, base, slow_log2(model, doc, lm.DEPTH) * math.log10(2)))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=lambda r: (r[0], r[6])), strict=True):
        assert tuple(g[:5]) == w[:5]
        assert math.isclose(g.base_score, w[5], rel_tol=1e-9) and math.isclose(g.score, w[6], rel_tol=1e-4, abs_tol=1e-3)


def test_against_the_definition(spark, docs, small):
    check(docs, [(r[0], r[1]) for r in small if len(r[1] or "") < 10_000] + [(r[0], r[1]) for r in small if len(r[1] or "") >= 10_000])
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab c") for _ in range(rng.randrange(60)))) for i in range(50)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_small_holds(spark, monkeypatch):
    rows = [(i, f"some words {i} and more {i % 7}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted(map(tuple, lm.score(frame).collect()))
    monkeypatch.setattr(lm, "HELD_GRAMS", 50)
    monkeypatch.setattr(lm, "HELD_WORDS", 5)
    assert [r[:5] for r in want] == [r[:5] for r in sorted(map(tuple, lm.score(frame).collect()))]


def test_kt_and_edges(nothing, spark):
    a, b = np.array([0, 3, 20_000, 100_000]), np.array([0, 1, 5, 70_000])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(x + y + 1) for x, y in zip(a, b)]
    assert np.allclose(ctw.log_pe(a, b), want, rtol=1e-10, atol=1e-6)
    assert lm.score(nothing).count() == 0
    only_held = next(i for i in range(99) if crc32(str(i).encode()) % 5 == 1)
    r = lm.score(spark.createDataFrame([(only_held, "ab")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 2, 0, 0)
    assert math.isclose(r.score, -24 * math.log10(2), rel_tol=1e-6)


def test_held_out_beats_word_frequencies(spark):
    rows = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
