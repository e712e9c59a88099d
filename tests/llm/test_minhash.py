import random
import re

import numpy as np
import pytest
from test_jaccard_join import chains

from weftgraph.llm import common
from weftgraph.llm import jaccard_join as jj
from weftgraph.llm import minhash as mh


def slow(rows, percent=80, words=2):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        own = least.get(root(i), doc_id)
        least[root(i)] = doc_id if own is None else own if doc_id is None else min(doc_id, own)
    return sorted(((d, len(s), least[root(i)], d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_against_brute_force(spark, seed, monkeypatch):
    if seed == 12:
        monkeypatch.setattr(jj, "FEW", 0)
        monkeypatch.setattr(common, "FEW", 0)
    if seed == 13:
        monkeypatch.setattr(jj, "DENSE", 2)
        monkeypatch.setattr(jj, "PART_SHINGLES", 200)
    rows = chains(seed)
    assert found(mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == slow(rows)


def test_odd_rows(spark, docs, small, nothing):
    assert found(mh.near_duplicates(docs)) == slow([(r[0], r[1]) for r in small])
    assert mh.near_duplicates(nothing).count() == 0
    rows = [(None, "a b c d e f g h"), (None, "a b c d e f g h"), (None, None), (7, "a b c d e f g h i"), (8, "z y"), (8, "x w v"), (9, "X W v"), (10, ""), (11, " ".join(f"w{i}" for i in range(200_000)))]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "'d' as digest", "2 as component_id", "3 as keys", "4 as member")
    assert found(mh.near_duplicates(table)) == slow(rows)


@pytest.mark.parametrize("size", [4, 9, 50, 400, 3000])
def test_every_coordinate_fills_and_agrees_as_often_as_sets_do(size):
    rng = np.random.default_rng(size)
    left, right, t = [], [], 128
    for _ in range(200):
        every = np.unique(rng.integers(0, 2**63, 2 * size).astype(np.uint64))
        rng.shuffle(every)
        common = size - max(1, size // 9)
        left.append(np.sort(every[:size]))
        right.append(np.sort(np.concatenate([every[:common], every[size : 2 * size - common]])))
    a, b = mh.sketches(left, t), mh.sketches(right, t)
    assert (a != ~np.uint64(0)).all() and a.shape == (200, t)
    similarity = common / (2 * size - common)
    agree = (a == b).mean(axis=1)
    assert abs(agree.mean() - similarity) < 4 * (similarity * (1 - similarity) / t / 200) ** 0.5
    assert agree.std() < 1.25 * (similarity * (1 - similarity) / t) ** 0.5


def test_batches_do_not_matter():
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(2**63) for _ in range(n)], np.uint64)) for n in (0, 1, 3, 4, 5, 17, 300, 2000)]
    alone = [mh.sketches([s], 64)[0] for s in sets]
    assert (mh.sketches(sets, 64) == np.array(alone)).all()
    keys = mh.Bands().each(sets)
    assert [len(k) for k, _ in keys] == [0, 0, 0, 32, 32, 32, 32, 32]


def test_pairs_at_the_threshold_meet():
    """Of 4,000 pairs of similarity 0.8, as good as all share a key."""
    rng = np.random.default_rng(5)
    made = mh.Bands()
    every = rng.integers(0, 2**63, (4000, 100)).astype(np.uint64)
    a, b = made.each(list(every[:, :90])), made.each([np.concatenate([x[:80], x[90:]]) for x in every])
    assert all(np.intersect1d(x, y).size for (x, _), (y, _) in zip(a, b, strict=True))
