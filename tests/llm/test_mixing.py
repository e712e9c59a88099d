import math
import re
from collections import Counter, defaultdict

import pytest

from weftgraph.llm import mixing as mx


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, fixed, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        goal |= {s: left * weight[s] / total for s in free}
        over = [s for s in free if goal[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return goal
        for s in over:
            goal[s] = 3.0 * sizes[s]
            fixed.add(s)
            left -= goal[s]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(frame, rows, slack):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    goals = slow_targets(dict(sizes))
    got = mx.report(frame).collect()
    by = {(i, words(t)): s for i, t, s in rows}
    taken, biggest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        source = by[r.doc_id, r.size]
        assert r.source_size == sizes[source] and r.target == pytest.approx(goals[source], rel=1e-9)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
        biggest[source] = max(biggest[source], r.size)
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= slack * biggest[s] + 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mx.report(frame.repartition(5)).collect()))


def test_against_brute_force(docs, small, table):
    check(docs, [(r[0], r[1], r[3]) for r in small], 1.01)
    check(table, [tuple(r) for r in table.select("doc_id", "text", "source").collect()], 1.01)


def test_hot_source_and_ties(spark, monkeypatch):
    monkeypatch.setattr(mx, "CELL_ROWS", 7)
    rows = [(i, "a b c" if i % 3 else "a " * (1 + i % 40), "hot" if i % 2 else f"s{i % 12}") for i in range(900)] + [(2000, "x " * 5000, "zz"), (2001, None, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows, 1.01)


def test_mix_repeats_rows(docs, nothing, small):
    taken = {(r.doc_id, r.size): r.copies for r in mx.copies(docs).collect()}
    got = defaultdict(int)
    mixed = mx.mix(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r.doc_id, words(r.text)] += 1
    assert all(got[k] == n for k, n in taken.items() if k[0] != 14)
    assert mx.report(nothing).count() == 0 and mx.mix(nothing).count() == 0


def test_mix_counts_rows_of_one_id_apart(spark):
    """Every row comes as often as systematic sampling says, whether or not others share its id."""
    rows = [(i // 4 if i % 8 else None, f"a b w{i}", "a" if i % 2 else "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    wanted = Counter()
    for r in mx.copies(docs).collect():
        wanted[r.doc_id, r.source] += r.copies
    got = mx.mix(docs).collect()
    assert Counter((r.doc_id, r.source) for r in got) == +wanted
    assert abs(sum(r.source == "b" for r in got) - 200 * 2 / 7) <= 1.01 and max(Counter(r.text for r in got).values()) == 2


def test_copies_against_a_walk_along_each_source(spark, table):
    """Brute force of ``taken``: one source after the other, from its offset, a copy for each integer crossed."""
    rows = table.select("doc_id", "source", "text")
    offset = "shiftrightunsigned(xxhash64(6, coalesce(source, ''), source IS NULL), 33) / 2147483648D AS offset"
    seeded = {r.doc_id: r for r in rows.selectExpr("doc_id", "xxhash64(5, doc_id, text) AS draw", offset).collect()}
    by = defaultdict(list)
    for r in mx.copies(rows, seed=5).collect():
        by[r.source].append(r)
    assert len(by) > 5
    for many in by.values():
        many.sort(key=lambda r: (r.size, seeded[r.doc_id].draw, r.doc_id))
        rate, start = min(many[0].target / many[0].source_size, 3.0), seeded[many[0].doc_id].offset
        crossed = [math.floor(i * rate + start) for i in range(len(many) + 1)]
        assert [r.copies for r in many] == [b - a for a, b in zip(crossed, crossed[1:])]


def test_mean_copies_over_offsets_are_the_expected_ones(spark, monkeypatch):
    """Each document's mean copies over seeds equal target / size within four errors of the mean."""
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 40}") for i in range(400)]
    docs = mx.stored(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1), "docs")
    n, total, rates = 8, Counter(), {}
    for seed in range(n):
        for r in mx.copies(docs, seed=seed).collect():
            total[r.source] += r.copies
            rates[r.source] = 10 * r.target / r.source_size
    off = [total[s] / n - rate for s, rate in rates.items()]
    assert abs(sum(off) / len(off)) < 4 * 0.5 / math.sqrt(n * len(off))
