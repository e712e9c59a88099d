import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftgraph.buckets import BucketTable, Conflict
from weftgraph.operators import paths

AS_OF = "2024-06-01 00:00:00"


def least_path(edges, start, goal, most):
    """The least of the shortest paths, by its nodes; of parallel edges the least type."""
    near = {}
    for a, t, b in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})[y] = min(t, near.get(x, {}).get(y, t))
    depth, todo = {goal: 0}, deque([goal])
    while todo:
        x = todo.popleft()
        for y in near.get(x, {}):
            if y not in depth:
                depth[y] = depth[x] + 1
                todo.append(y)
    if start not in depth and start != goal or depth.get(start, 0) > most:
        return None
    nodes, kinds = [start], []
    while nodes[-1] != goal:
        x = nodes[-1]
        y = min(y for y in near[x] if depth.get(y, 99) == depth[x] - 1)
        nodes.append(y)
        kinds.append(near[x][y])
    return nodes, kinds


@pytest.mark.parametrize("seed,nodes,many,most", [(1, 40, 60, 5), (2, 30, 34, 4)])
def test_paths_of_many_pairs(spark, seed, nodes, many, most, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(paths, "BROADCAST_ROWS", 0)
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(nodes):02d}"
    edges = [(name(), rng.choice("ABC"), name()) for _ in range(many)] + [("hub", "H", f"n{i:02d}") for i in range(0, nodes, 3)]
    pairs = [(name(), name()) for _ in range(60)] + [("hub", "n00"), ("n01", "n01"), ("n01", "nowhere"), (None, "n01"), ("nowhere", "nowhere"), ("n02", "n05"), ("n02", "n05")]
    frame = spark.createDataFrame(edges + [(None, "A", "n01")], "src string, type string, dst string")
    got = paths.shortest_paths(paths.adjacency(frame), spark.createDataFrame(pairs, "start string, goal string"), most).collect()
    want = {}
    for s, g in pairs:
        if s is not None and (found := least_path(edges, s, g, most)):
            want[s, g] = found
    assert {(r.start, r.goal): (r.nodes, r.relations) for r in got} == want and len(got) == len(want)
    assert all(r.distance == len(r.relations) for r in got)
    assert paths.shortest_paths(paths.adjacency(frame), spark.createDataFrame([], "start string, goal string")).count() == 0


def test_leaves_are_not_walked(spark):
    """A hundred nodes of one neighbour hang on the hub: paths go by none of them, and to the one that is asked for."""
    edges = spark.createDataFrame([("hub", "H", f"leaf{i}") for i in range(100)] + [("hub", "A", "x"), ("x", "A", "y")], "src string, type string, dst string")
    pairs = spark.createDataFrame([("hub", "y"), ("y", "leaf7")], "start string, goal string")
    near = paths.adjacency(edges)
    assert {tuple(sorted((r.a, r.b))) for r in paths.passable(near, pairs).collect()} == {("hub", "x"), ("x", "y"), ("hub", "leaf7")}
    assert {(r.start, tuple(r.nodes)) for r in paths.shortest_paths(near, pairs).collect()} == {("hub", ("hub", "x", "y")), ("y", ("y", "x", "hub", "leaf7"))}


def rows_of(df):
    return {r.k: r.v for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    made = BucketTable(spark, f"file://{tmp_path}/t", ["k"], "k string, v long, created_at timestamp, updated_at timestamp", 8)
    made.upsert(spark.range(200).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")), AS_OF)
    return made


def one(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v long")


def test_changes_touch_their_buckets_only(spark, table):
    before = set(table.read().inputFiles())
    assert table.upsert(one(spark, ("k5", 500), ("new", 1)), AS_OF) == 2
    after = set(table.read().inputFiles())
    assert len(after - before) <= 2 and len(before & after) >= len(before) - 2
    want = {f"k{i}": i for i in range(200)} | {"k5": 500, "new": 1}
    assert rows_of(table.read()) == want and rows_of(table.read(1))["k5"] == 5
    assert table.delete(one(spark, ("k5", 0), ("absent", 0))) == 3
    assert rows_of(table.read()) == {k: v for k, v in want.items() if k != "k5"} and table.versions() == [1, 2, 3]
    assert table.upsert(one(spark), AS_OF) == 3


def test_two_writers_lose_nothing(spark, table):
    """The second writer finds its version taken, whether it touched the same bucket or another."""
    for mine, other in ((("k1", -1), ("k1b", -2)), (("k1", -3), ("k1", -4))):
        once = [True]

        def first(other=other, once=once):
            if once.pop() if once else False:
                table.upsert(one(spark, other), AS_OF)

        version = table.upsert(one(spark, mine), AS_OF, before_commit=first)
        got = rows_of(table.read())
        assert got[mine[0]] == mine[1] and got[other[0]] == (mine if mine[0] == other[0] else other)[1]
        assert version == table.versions()[-1] and len(got) >= 200


def test_a_writer_that_is_always_late_gives_up(spark, table):
    n = [0]

    def first():
        n[0] += 1
        table._commit(table.versions()[-1] + 1, table._snapshot()[1])

    with pytest.raises(Conflict):
        table.upsert(one(spark, ("k1", 1)), AS_OF, retries=2, before_commit=first)
    assert n[0] == 2


def test_keys_stay_unique(spark, table):
    rows = one(spark, ("k1", 0), ("fresh", 1), ("twice", 2), ("twice", 3), (None, 4))
    assert {(r.k, r.n, r.existing) for r in table.taken(rows).collect()} == {("k1", 1, True), ("twice", 2, False), (None, 1, False)}
    stamps = lambda df: df.selectExpr("k", "v", "cast(null as timestamp) created_at", "cast(null as timestamp) updated_at")
    with pytest.raises(ValueError):
        table.insert(stamps(rows))
    assert table.versions() == [1]
    table.insert(stamps(rows.where("k = 'fresh'")))
    assert rows_of(table.read())["fresh"] == 1


def test_a_change_is_shuffled_once(spark, table, monkeypatch):
    """Old and incoming rows are dealt by bucket once; null keys match nothing, and of incoming rows of a key the last by the order counts."""
    plans, write = [], BucketTable._write

    def noted(self, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(self, rows)

    monkeypatch.setattr(BucketTable, "_write", noted)
    table.upsert(one(spark, ("k1", 7), ("k1", 3), (None, 4), ("k2", None)), AS_OF, order="v")
    table.upsert(one(spark, (None, 5)), AS_OF)
    table.delete(one(spark, ("k3", 0), (None, 0)))
    assert plans == [1, 1, 1]
    got = sorted(((r.k, r.v) for r in table.read().collect()), key=repr)
    want = {f"k{i}": i for i in range(200) if i != 3} | {"k1": 7}
    assert got == sorted([*want.items(), (None, 4), (None, 5)], key=repr)
