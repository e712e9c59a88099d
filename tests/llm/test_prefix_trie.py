import random
import re
from hashlib import sha256
from zlib import crc32

import pytest

from weftgraph.llm import common
from weftgraph.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow(rows, shared=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    made = {}
    for c, ts in own.items():
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        h = crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(base, [])[:h] + ts[h:]) if shared else tuple(ts)
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids, out = {}, []
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def under(p):
        """Leaves and saved words of a subtree."""
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves, saved = (0 if p in kids else 1), (len(members[p]) - 1) * words
        for k in kids.get(p, []):
            a, b = under(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if made[c] == p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), *under(p), sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def dialogues(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 8 * n), n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.choice([1, 1, 2])))))
    return rows


@pytest.mark.parametrize("seed,width,run", [(1, 1, 1 << 16), (2, 7, 1 << 16), (3, 40, 2), (4, 150, 1)])
def test_against_brute_force(spark, seed, width, run, monkeypatch):
    """Few distinct texts, so that prefixes and groups of copies span many partitions."""
    if seed == 3:
        monkeypatch.setattr(common, "FEW", 0)
    rows = dialogues(seed, 300)
    arrays = pt.with_shared_beginnings(pt.turn_arrays(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert found(pt.trie(arrays, width)) == slow(rows)


@pytest.mark.parametrize("seed", range(30))
def test_sweeps_and_stitches(seed, monkeypatch):
    """Any cut of the sorted conversations into partitions gives the same nodes; no Spark."""
    import pyarrow as pa

    rng = random.Random(seed)
    monkeypatch.setattr(pt, "RUN", rng.choice([1, 2, 3, 1000]))
    convs = sorted((bytes(b for x in [rng.randrange(3) for _ in range(rng.choice([0, 1, 2, 3, 6]))] for b in [x] * pt.TURN), c) for c in range(rng.choice([1, 2, 5, 60])))
    cuts = sorted(rng.randrange(len(convs) + 1) for _ in range(rng.randrange(12)))
    parts = [convs[a:b] for a, b in zip([0, *cuts], [*cuts, len(convs)], strict=True)]
    rows = []
    for p, part in enumerate(parts):
        batch = pa.table({"conv_id": pa.array([c for _, c in part], pa.int64()), "key": pa.array([k for k, _ in part], pa.binary()), "words": pa.array([[k[i] + 1 for i in range(0, len(k), pt.TURN)] for k, _ in part], pa.list_(pa.int32())), "part": pa.array([p] * len(part), pa.int32())})
        rows += [r for b in pt._sweep(iter(batch.to_batches(max_chunksize=3))) for r in b.to_pylist()]
    summaries = pa.table({"blob": pa.array([r["blob"] for r in rows if r["kind"] == pt.SUMMARY], pa.binary())})
    rows += [r for b in pt._stitch(iter(summaries.to_batches(max_chunksize=2))) for r in b.to_pylist()]
    runs = sorted((r["node"], r["part"], r["seq"], r["blob"]) for r in rows if r["kind"] == pt.ENDS)
    table = pa.table({"node": pa.array([r[0] for r in runs], pa.binary()), "blob": pa.array([r[3] for r in runs], pa.binary())})
    hashes = {r["node"]: r["hash"] for b in pt._hash_runs(iter(table.to_batches(max_chunksize=2))) for r in b.to_pylist()}
    nodes = [r for r in rows if r["kind"] == pt.NODE]
    names = {r["node"]: r["conv_id"] for r in nodes if r["node"] is not None}
    got = sorted(((r["conv_id"], r["depth"], names[r["parent"]] if r["parent"] is not None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"] or hashes[r["node"]]) for r in nodes), key=repr)
    text = lambda x: " ".join(["w"] * (x + 1))
    assert got == [tuple(r) for r in slow_of(convs, text)]


def slow_of(convs, text):
    rows, empty = [], []
    for key, c in convs:
        turns = [key[i] for i in range(0, len(key), pt.TURN)]
        rows += [(c, i, "r", text(x)) for i, x in enumerate(turns)]
        if not turns:
            empty.append(c)
    return slow_with(rows, empty)


def slow_with(rows, empty):
    """Brute force with conversations that have no turn."""
    made = {c: () for c in empty}
    for c, _, role, text in rows:
        made[c] = (*made.get(c, ()), (role, text))
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(1 for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below))
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].split()) if q else 0) for q in below)
        ends = ",".join(map(str, sorted(c for c in cs if made[c] == p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows(spark):
    """Nulls in any column, equal turns, repeated rows, lone beginnings, extreme ids, a long conversation, clashing names."""
    rows = [(0, 0, "user", "a b"), (0, 1, None, None), (0, None, "user", "first"), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "user", ""), (3, 1, "r", "only one"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(2**63 - 1, 0, "user", "largest"), (-(2**63), 0, "user", "smallest"), (-5, 0, "user", "neg"), (27, 0, "user", "alone"), (33, 1, "user", "alone")]
    rows += [(40, i, "user", f"turn {i}") for i in range(700)] + [(41, i, "user", f"turn {i}") for i in range(690)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'k' as key", "1 as words", "2 as part", "3 as of", "4 as n", "5 as node").repartition(3)
    assert found(pt.report(table)) == slow(rows)
    assert pt.report(table.where("false")).count() == 0
    assert pt.report(table.where("conv_id is null")).count() == 0
    assert found(pt.report(table.where("conv_id = 27"))) == slow([r for r in rows if r[0] == 27])
