import random
import re
from math import isclose, sqrt

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.vectors import hash_sums, hash_vectors
from weftgraph.operators import batch, search, text_index, traverse
from weftgraph.operators import vector_index as vi
from weftgraph.operators.answer import Tables
from weftgraph.plans.queries import QUERIES


def cos(a, b):
    n = sqrt(sum(x * x for x in a)) * sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def points(seed, n, dims=6, groups=7):
    """Clusters, copies, zero vectors and lone ones."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in rng.choice(middles)]) for i in range(n)]
    rows[3] = (3, rows[2][1])
    rows[5] = rows[7] = (5, [0.0] * dims)
    rows[7] = (7, [0.0] * dims)
    return rows


def slow(rows, queries, k, like=cos):
    out = {}
    for q, v in queries:
        best = sorted(((-like(v, w), i) for i, w in rows))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def same(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query, {})[r.place] = (r.key, r.score)
    assert set(found) == set(want)
    for q, rows in want.items():
        mine = [found[q][p] for p in sorted(found[q])]
        assert [p for p in sorted(found[q])] == list(range(1, len(rows) + 1))
        assert all(isclose(a[1], b[1], abs_tol=1e-6) for a, b in zip(mine, rows, strict=True))
        assert [a[0] for a in mine] == [b[0] for b in rows]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = points(1, 600)
    odd = [(900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(4)
    path = f"file://{tmp_path_factory.mktemp('index')}"
    vi.build(df, "id", "v", path, 6, cells=12)
    return rows, df, vi.load(spark, path)


def test_exact_search_is_exact(spark, indexed, monkeypatch):
    monkeypatch.setattr(vi, "ROWS_EACH", 40)
    monkeypatch.setattr(vi, "QUERIES_EACH", 7)
    rows, df, index = indexed
    wanted = df.where("id % 20 = 0 or id = 5 or id >= 900")
    got = vi.search(index, wanted, "id", "v", 10, probes=2, exact=True).collect()
    same(got, slow(rows, [r for r in rows if r[0] % 20 == 0 or r[0] == 5], 10))


def test_recall_and_files_read(spark, indexed):
    """Probing a third of the cells finds nine tenths of the neighbours, and reads those cells' files only."""
    rows, df, index = indexed
    wanted = df.where("id % 20 = 0")
    truth = vi.nearest_each(wanted, "id", "v", df, "id", "v", 6, 10)
    same(truth.collect(), slow(rows, [r for r in rows if r[0] % 20 == 0], 10))
    assert vi.recall(vi.search(index, wanted, "id", "v", 10, probes=4), truth) >= 0.9
    assert int(index.sizes.sum()) == 600
    every = len(index.rows(spark).inputFiles())
    some = index.rows(spark, [0, 1])
    assert some.select("code").where("cell in (0, 1)").count() == index.sizes[0] + index.sizes[1]
    assert "PartitionFilters: [isnotnull(cell" in some._jdf.queryExecution().toString() or every > 2


def test_euclidean(spark, tmp_path):
    rows = points(2, 200)
    df = spark.createDataFrame(rows, "id long, v array<float>")
    index = vi.build(df, "id", "v", f"file://{tmp_path}", 6, similarity="euclidean", cells=5)
    like = lambda a, b: 1 / (1 + sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))))
    as_floats = {r.id: list(r.v) for r in df.collect()}
    got = vi.search(index, df.where("id % 50 = 0"), "id", "v", 5, probes=1, exact=True).collect()
    same(got, slow(list(as_floats.items()), [(i, as_floats[i]) for i in range(0, 200, 50)], 5, like))


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    index = vi.build(none, "id", "v", f"file://{tmp_path}", 6)
    assert vi.search(index, none, "id", "v").count() == 0 and index.sizes.sum() == 0
    assert vi.similar_pairs(none, "id", "v", 6).count() == 0


@pytest.mark.parametrize("least", [0.8, 0.97])
def test_similar_pairs_are_all_pairs(spark, least, monkeypatch):
    monkeypatch.setattr(vi, "ROWS_EACH", 25)
    monkeypatch.setattr(vi, "QUERIES_EACH", 30)
    rows = points(3, 250)
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {(r.src, r.dst): r.score for r in vi.similar_pairs(df, "id", "v", 6, least, pivots=15).collect()}
    want = {(a, b): cos(v, w) for a, v in rows for b, w in rows if a < b and cos(v, w) >= least}
    assert set(got) == set(want) and all(isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    plan = vi.cell_plan(df, "id", "v", 6, least, pivots=15).groupBy("cell").agg(F.count_if("home").alias("home"), F.count(F.lit(1)).alias("every"))
    compared = plan.agg(F.sum(F.col("home") * F.col("every"))).first()[0]
    assert compared < 250 * 250 * (0.6 if least > 0.9 else 1.2)


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(9)
    words = ["harbour", "Harvest", "port", "report", "sea", "lighthouse", "light", "ships", "x", "über"]
    chunks = [(f"c{i:03d}", f"d{i // 4}", i % 4, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 8]))), rng.choice([True, True, None, False])) for i in range(160)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    mentions = [(c[0], rng.choice(words + ["ort", ""]), "T") for c in chunks for _ in range(2) if rng.random() < 0.4]
    tags = [(c[0], rng.choice(words)) for c in chunks if rng.random() < 0.3]
    edges = [(c[1], "CONTAINS", c[0]) for c in chunks] + [(c, "MENTIONS", f"e:{n}") for c, n, _ in mentions] + [(c, "HAS_TAG", f"t:{t}") for c, t in tags]
    nodes = {(d, "Document") for _, d, *_ in chunks} | {(c[0], "Chunk") for c in chunks} | {(e[2], "Entity" if e[1] == "MENTIONS" else "Tag") for e in edges if e[1] != "CONTAINS"}
    return Tables(
        frame([(f"d{i}", f"Title {i}") for i in range(40)], "doc_id string, title string"),
        frame(chunks, "chunk_id string, doc_id string, chunk_index int, text string, active boolean"),
        frame(mentions, "chunk_id string, name string, type string"),
        frame(tags, "chunk_id string, tag string"),
        frame([], "chunk_id string, embedding array<double>"),
        frame(sorted(nodes), "id string, label string"),
        frame(edges, "src string, type string, dst string"),
    )


@pytest.mark.parametrize("question", ["the harbour report", "Lighthouse light and port", "x", "no such thing", "", "über"])
def test_lexical_search_by_the_index(spark, graph, question, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "LIST", 20)
    made = text_index.index(graph.chunks, graph.mentions, graph.tags, f"file://{tmp_path}")
    args = (graph.chunks, graph.documents, graph.mentions, graph.tags, question, 7)
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(text_index.search(made, *args)) == order(search.lexical_search(*args))


def test_batch_expansion_is_the_single_one(spark, graph):
    """Frontiers of many questions, with hubs and limits, find what one question alone finds."""
    rng = random.Random(4)
    ids = [r.id for r in graph.nodes.collect()]
    seeds = {f"q{k}": rng.sample(ids, rng.choice([1, 2, 5])) for k in range(6)}
    for hops, limit in ((2, 50), (2, 6), (3, 15)):
        near = batch.adjacency(graph.edges, graph.nodes, limit)
        got = batch.expanded(near, graph.nodes, spark.createDataFrame([(q, i) for q, own in seeds.items() for i in own], "qid string, id string"), hops, limit)
        found = {}
        for r in got.collect():
            found.setdefault(r.qid, set()).add((r.id, r.label, r.depth))
        for q, own in list(seeds.items())[:3]:
            alone = traverse.subgraph(graph.edges, graph.nodes, spark.createDataFrame([(i,) for i in own], "id string"), hops, limit)[0]
            assert found[q] == {(r.id, r.label, r.depth) for r in alone.collect()}


def test_postings_of_blocks(monkeypatch):
    values = ["harbour", "ab", "", "bourbon", "über 𝔸𝔹ℂ", "aaaa"]
    grams, ends, steps = text_index.postings(values)
    found, start = {}, 0
    for g, end in zip(grams, ends, strict=True):
        found[g] = steps[start:end].astype(int).cumsum().tolist()
        start = end
    assert found == {g: [i for i, v in enumerate(values) if g in v] for v in values for g in text_index.grams_of(v)}
    assert [len(x) for x in text_index.postings(["", "ab"])] == [0, 0, 0] and text_index.postings([""])[0] == []
    monkeypatch.setattr(text_index, "MOST_LETTERS", 10)
    cut = list(text_index._blocks(values))
    assert [v for at, part in cut for v in part] == values and [at for at, _ in cut] == sorted({at for at, _ in cut})
    assert all(len(part) == 1 or sum(map(len, part)) <= 10 for _, part in cut)


def test_index_is_built_without_a_shuffle(spark, graph, tmp_path, monkeypatch):
    """No row for a gram and a value goes through a shuffle."""
    seen = []
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", lambda self, path: seen.append(self._df))
    text_index.build(graph.chunks, "chunk_id", "text", f"file://{tmp_path}")
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_similar_pairs_by_few_axes_and_small_tiles(spark, monkeypatch):
    """Projections that leave much out, and blocks and tiles of few rows, lose no pair; a row is shuffled once a block."""
    for name, value in {"AXES": 2, "TILE": 16, "PAIR_ROWS": 90, "PAIR_BLOCKS": 2, "ROWS_EACH": 200}.items():
        monkeypatch.setattr(vi, name, value)
    rows = points(5, 250)
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    found = vi.similar_pairs(df, "id", "v", 6, 0.9)
    got = {(r.src, r.dst): r.score for r in found.collect()}
    want = {(a, b): cos(v, w) for a, v in rows for b, w in rows if a < b and cos(v, w) >= 0.9}
    assert set(got) == set(want) and all(isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert "explode(sequence(0, 2" in found._jdf.queryExecution().toString()


def test_pairs_are_found_without_a_shuffle(spark, monkeypatch):
    """Packs of a few rows meet as a product of the stored table: vectors go through no exchange, however many blocks there are."""
    monkeypatch.setattr(vi, "PACK_ROWS", 40)
    monkeypatch.setattr(vi, "PAIR_ROWS", 30)
    monkeypatch.setattr(vi, "SIDES", 1)
    rows = points(6, 200) + [(900, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    found = vi.similar_pairs(df, "id", "v", 6, 0.9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    got = sorted((r.src, r.dst) for r in found.collect())
    assert got == sorted((a, b) for a, v in rows for b, w in rows if a < b and any(v) and any(w) and cos(v, w) >= 0.9)


def test_linked_pairs_are_looked_for_once(spark):
    """The edges to ends that don't exist come from the same comparison."""
    found = QUERIES["link_similarities"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") == 1


def test_nearest_texts_are_found_where_they_are_read(spark, monkeypatch):
    """Like a slow search, in packs of a few rows, without an exchange of vectors; of texts of one direction the smaller key comes first."""
    monkeypatch.setattr(vi, "PACK_ROWS", 17)
    monkeypatch.setattr(vi, "QUERIES_EACH", 3)
    rng = random.Random(8)
    words = ["harbour", "sea", "port", "ships", "light", "über", "x"]
    texts = [(f"d{i:02d}", " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5])))) for i in range(70)]
    texts += [("b2", "sea port " * 7), ("b1", "sea port"), ("b3", "port sea " * 3), ("none", " . ")]
    df = spark.createDataFrame(texts, "id string, text string").repartition(3)
    asked = spark.createDataFrame([("q1", "port sea"), ("q2", "light über x"), ("q3", "ships"), ("q4", "sea"), ("q5", "")], "qid string, text string")
    vectors = {r.id: list(r.vec) for r in hash_vectors(df, "id", "text", 32).collect()}
    wanted = [(r.qid, list(r.vec)) for r in hash_vectors(asked, "qid", "text", 32).collect() if any(r.vec)]
    like = lambda a, b: round(cos(a, b), 12)
    found = vi.nearest_sparse(hash_sums(asked, "qid", "text", 32), "qid", hash_sums(df, "id", "text", 32), "id", 32, 6)
    same(found.collect(), slow([(k, v) for k, v in vectors.items() if any(v)], wanted, 6, like))
    assert [r.key for r in found.where("query = 'q1' and place <= 3").orderBy("place").collect()] == ["b1", "b2", "b3"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"query"}


def test_adjacency_of_reached_nodes(spark, graph):
    """Made for a hop's nodes only, from edges that come again too: the same expansion, and other nodes' edges are left out before the shuffle."""
    twice = graph.edges.unionByName(graph.edges)
    seeds = spark.createDataFrame([("q1", "c003"), ("q1", "d1"), ("q2", "c010")], "qid string, id string")
    for limit in (3, 50):
        whole = batch.expanded(batch.adjacency(graph.edges, graph.nodes, limit), graph.nodes, seeds, 2, limit)
        some = batch.expanded(lambda of, limit=limit: batch.adjacency(twice, graph.nodes, limit, of), graph.nodes, seeds, 2, limit)
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.collect()))
    near = batch.adjacency(twice, graph.nodes, 50, spark.createDataFrame([("c003",)], "a string"))
    assert {r.a for r in near.collect()} == {"c003"} and near.count() == near.distinct().count()
