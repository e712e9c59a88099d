import random
import re

import pytest

from weftgraph.llm import common
from weftgraph.llm import jaccard_join as jj


def slow(rows):
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((doc_id, len(s), least[root(i)]) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True)))


def chains(seed, n=160):
    """Groups that drift: neighbours link, ends don't; small and large sets; a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    passage = [word() for _ in range(25)]
    rows = []
    while len(rows) < n:
        text = [word() for _ in range(rng.choice([2, 3, 5, 9, 12, 20, 30, 60, 150]))]
        if rng.random() < 0.5:
            text = text + passage
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            rows.append(list(text))
            for _ in range(rng.randrange(0, 2 + len(text) // 60)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text.append(word())
    rng.shuffle(rows)
    return [(i * 3, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed,boundary", [(1, None), (2, 0), (3, 25), (4, 1000)])
def test_against_brute_force(spark, seed, boundary, monkeypatch):
    if boundary is not None:
        monkeypatch.setattr(jj, "choose_boundary", lambda *_: boundary)
    if seed == 2:
        monkeypatch.setattr(jj, "DENSE", 1)  # all in blocks
    if seed == 3:
        monkeypatch.setattr(jj, "BROADCAST_IDS", 0)
        monkeypatch.setattr(jj, "HELD", 500)
        monkeypatch.setattr(jj, "FEW", 0)  # every table is looked through for hot keys
        monkeypatch.setattr(common, "FEW", 0)
        monkeypatch.setattr(jj, "DENSE", 2)
        monkeypatch.setattr(jj, "PART_SHINGLES", 150)  # blocks of few members, pairs of parts
    if seed == 4:
        monkeypatch.setattr(jj, "map_bits", lambda _: (11, 11, 11))  # maps that are full
    rows = chains(seed)
    got = jj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect())) == slow(rows)


def test_edges(docs, nothing, small):
    assert sorted(map(tuple, jj.join(docs).collect())) == slow([(r[0], r[1]) for r in small])
    assert jj.join(nothing).count() == 0
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[2] for r in slow([(r[0], r[1]) for r in small])})


def test_boundary_has_least_cost():
    import numpy as np

    sizes = np.array([8, 10, 20, 40, 80, 600])
    cost = lambda x, length: sum((s + 2) * (s + 1) / 2 if n <= x else (s + 1) * (1 + length) for n in sizes for s in [n - jj.needed(int(n))])
    for length in (0.0, 1.0, 5.0, 100.0):
        x = jj.choose_boundary(sizes, np.ones(len(sizes)), length)
        assert cost(x, length) == min(cost(y, length) for y in (0, *sizes))


def test_components_of_paths(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60) if i != 30] + [(100 + rng.randrange(20), 100 + rng.randrange(20)) for _ in range(15)]
    got = {r.node: r.component for r in jj.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[i] == 31 for i in range(32, 61))
