from collections import defaultdict
from itertools import combinations

import pyarrow as pa
import pytest

from weftgraph.operators import kb, keyword_pairs
from weftgraph.operators.joins import components


def brute(rows, least):
    own = defaultdict(set)
    for d, k in rows:
        if d is not None and k is not None:
            own[d].add(k)
    return sorted((a, b, len(own[a] & own[b])) for a, b in combinations(sorted(own), 2) if len(own[a] & own[b]) >= least)


#: A keyword in nearly all, one set in a third of all, sets of one keyword, repeated rows, nulls.
ROWS = [(i, "all") for i in range(0, 119)] + [(i, w) for i in range(40) for w in ("same", "set")]
ROWS += [(i, f"k{i * j % 23}") for i in range(40, 120) for j in range(1, 7)] + [(200, "only"), (201, "k1"), (201, "k1"), (None, "k1"), (202, None)]


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_pairs_like_brute_force(spark, least):
    rows = spark.createDataFrame(ROWS, "doc_id long, keyword string").selectExpr("*", "keyword AS words", "1 AS n").repartition(3)
    got = kb.similarity_edges(rows.where("doc_id is not null"), least)
    assert sorted(map(tuple, got.collect())) == brute(ROWS, least)
    if least > 1:
        assert sorted(map(tuple, kb.similarity_edges(rows, least).collect())) == brute(ROWS, least)


def test_slices_of_a_hot_keyword(spark):
    """However a keyword is cut, each pair comes once; its classes are dealt to several cells."""
    rows = spark.createDataFrame(ROWS, "doc_id long, keyword string")
    _, listed = keyword_pairs.classes(rows, 2)
    whole = sorted(map(tuple, keyword_pairs.class_edges(listed, 2).collect()))
    assert whole and whole == sorted(map(tuple, keyword_pairs.class_edges(listed, 2, width=7).collect()))


def test_one_class(spark):
    """Documents of one set are members of one class, not pairs, until pairs are asked for."""
    members, listed = keyword_pairs.classes(spark.createDataFrame(ROWS[119:199], "doc_id long, keyword string"), 2)
    assert (members.count(), listed.count(), keyword_pairs.class_edges(listed, 2).count()) == (40, 1, 0)


def records_shuffled(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_are_not_shuffled(spark):
    """However many pairs there are, only documents are dealt; tables are too large for a broadcast here."""
    rows = [(i, w) for i in range(1200) for w in ("x", "y", f"own{i}", f"own{i + 1}")]
    keywords = spark.createDataFrame(rows, "doc_id long, keyword string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = records_shuffled(spark)
        assert keyword_pairs.pairs(keywords, 2).count() == 1200 * 1199 // 2
        assert records_shuffled(spark) - before < 4 * len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_common_keywords(spark):
    """More than a byte can count; keywords that are no strings, ids whose order isn't that of numbers."""
    rows = [(d, k) for d in ("9", "10", "é", "z") for k in range(300)] + [("11", k) for k in range(257)]
    got = kb.similarity_edges(spark.createDataFrame(rows, "doc_id string, keyword long"), 250)
    assert sorted(map(tuple, got.collect())) == brute(rows, 250)


@pytest.mark.parametrize("frequent", [0, 1, 1000])
def test_tiles(monkeypatch, frequent):
    """Tiles of a few rows, keywords counted by bytes or by rows: the same pairs."""
    monkeypatch.setattr(keyword_pairs, "TILE", 11)
    monkeypatch.setattr(keyword_pairs, "MOST_FREQUENT", frequent)
    monkeypatch.setattr(keyword_pairs, "BATCH", 5)
    own = defaultdict(set)
    for d, k in ROWS:
        if d is not None and k is not None:
            own[d].add(k)
    rows = pa.RecordBatch.from_pylist([{"id": d, "words": sorted(w), "block": d % 2} for d, w in own.items()])
    rows = rows.set_column(2, "block", rows.column("block").cast(pa.int32()))
    packed = [r for b in keyword_pairs._packed([rows[:50], rows[50:]]) for r in b.to_pylist()]
    got = []
    for i, j in ((0, 0), (0, 1), (1, 1)):
        cell = keyword_pairs._Cell()
        for r in packed:
            if r["block"] in (i, j):
                cell.add(r["rows"], r["block"] == i)
        got += [tuple(r.values()) for b in cell.pairs(2, i == j) for r in b.to_pylist()]
    assert sorted(got) == brute(ROWS, 2)


def test_empty(spark):
    assert kb.similarity_edges(spark.createDataFrame([], "doc_id long, keyword string"), 2).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 299), (299, 301)]
    want = {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 140)}, 299: 299, 300: 299, 301: 299}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_pairs_of_one_keyword_are_not_shuffled(spark):
    """Pairs that share any keyword are the result; only documents are dealt on the way there."""
    rows = [(i, w) for i in range(1000) for w in ("x", f"own{i}", f"half{i // 2}")]
    keywords = spark.createDataFrame(rows, "doc_id long, keyword string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = records_shuffled(spark)
        got = kb.similarity_edges(keywords)
        assert got.groupBy("common_keywords").count().collect() and got.count() == 1000 * 999 // 2
        assert got.where("common_keywords = 2").count() == 500
        assert records_shuffled(spark) - before < 8 * len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
