import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.functions.vectors import added_sums, hash_embedding, hash_vectors, text_sums
from weftgraph.operators.words import Pick, top_words
from weftgraph.storage import stored

PICKS = [Pick(3, least=2, stop=frozenset(["sea"])), Pick(2, longest=True, least=4)]


def slow(rows):
    """By key: the most frequent words, and the longest (kind, word), of all its rows."""
    out = {}
    for key in {r[0] for r in rows}:
        own = [(kind, w) for k, text, kind in rows if k == key for w in (text or "").lower().split()]
        n = Counter(w for _, w in own)
        often = sorted((w for w in n if len(w) >= 2 and w != "sea"), key=lambda w: (-n[w], w))[:3]
        longest = sorted({(kind, w) for kind, w in own if len(w) >= 4}, key=lambda x: (-len(x[1]), x[1], x[0]))[:2]
        out[key] = ([(i + 1, w) for i, w in enumerate(often)], [(i + 1, kind, w) for i, (kind, w) in enumerate(longest)])
    return out


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_top_words_of_lone_and_shared_keys(spark, broadcast, monkeypatch):
    monkeypatch.setattr(storage, "MOST_BROADCAST", broadcast)
    rng = random.Random(3)
    words = ["Sea", "port", "über", "harbour", "ships", "a", "to", "lighthouse", "don-t", "x_1"]
    rows = [(rng.choice([None, 1, 2, 3, *range(10, 60)]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.choice([1, 5, 30])))]), rng.choice(["A", "B"])) for _ in range(90)]
    df = spark.createDataFrame(rows, "id long, text string, kind string").repartition(5)
    found = {}
    for r in top_words(df, "id", "text", PICKS, F.col("kind")).collect():
        found.setdefault(r.id, ([], []))[r.pick].append((r.place, r.word) if r.pick == 0 else (r.place, r.kind, r.word))
    want = {k: v for k, v in slow(rows).items() if v[0] or v[1]}
    assert {k: (sorted(a), sorted(b)) for k, (a, b) in found.items()} == want


def test_words_of_lone_keys_are_not_shuffled(spark):
    """Only the keys were, to tell whether they come again."""
    df = spark.createDataFrame([(i, "port and harbour") for i in range(20)], "id long, text string")
    plan = top_words(df, "id", "text", PICKS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_embeddings_by_row(spark):
    """Nothing of lone keys is shuffled; the dense form is the sparse one, also of keys that come again or are null."""
    lone = spark.createDataFrame([(i, "port and harbour " * i) for i in range(20)], "id long, text string")
    for made in (hash_embedding(lone, "id", "text"), hash_vectors(lone, "id", "text")):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    rows = [(1, "Sea port"), (1, "sea"), (2, None), (2, ""), (3, "über x_1 x_1"), (4, None), (None, "a b"), (None, "b c")]
    df = spark.createDataFrame(rows, "id long, text string")
    sparse = {}
    for r in hash_embedding(df, "id", "text", 32).collect():
        assert (r.id, r.dim) not in sparse
        sparse[r.id, r.dim] = r.weight
    vectors = {r.id: r.vec for r in hash_vectors(df, "id", "text", 32).collect()}
    assert set(vectors) == {1, 2, 3, 4, None} == {k for k, _ in sparse}
    for k, v in vectors.items():
        assert v == pytest.approx([sparse.get((k, d), 0.0) for d in range(32)])
    assert [d for k, d in sparse if k in (2, 4)] == [0, 0]


def test_sums_of_distinct_texts(spark):
    """Copies leave the least key, texts of one key add up, and nothing is kept of texts without a token or of tokens that cancel out."""
    rows = [("b", "sea port sea"), ("a", "sea port sea"), ("c", "über 12"), ("c", "sea"), ("d", " . "), ("e", None), (None, "sea"), ("f", "sea"), ("a", "sea port sea")]
    df = spark.createDataFrame(rows, "id string, text string").repartition(3)
    first = stored(text_sums(df, "id", "text", 32), "sums")
    got = {r.id: {p: x for p, x in zip(r.places, r.parts, strict=True)} for r in added_sums(first, "id").collect()}
    want = {r.id: r.vec for r in hash_vectors(spark.createDataFrame([("a", "sea port sea"), ("c", "über 12"), ("c", "sea")], "id string, text string"), "id", "text", 32).collect()}
    assert set(got) == set(want)
    for key, sums in got.items():
        length = sum(x * x for x in sums.values()) ** 0.5
        assert [sums.get(i, 0) / length for i in range(32)] == pytest.approx(want[key], abs=1e-12)
