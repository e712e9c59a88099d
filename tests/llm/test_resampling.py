import re
from collections import Counter
from hashlib import sha256
from math import floor, log
from zlib import crc32

import pytest

from weftgraph.llm import resampling as rs


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(text, longest):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def slow(rows, target, percent=10, least=20, buckets=10_000, longest=1):
    """(doc_id, features, weight, score) by row, and ranks."""
    bucket = lambda f: crc32(f.encode("utf-8", "surrogatepass")) % buckets
    s = Counter(bucket(f) for _, t in rows for f in runs(t, longest))
    t = Counter(bucket(f) for x in target for f in runs(x, longest))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: floor(1000 * log((t[b] + 1.0) * big_s / ((s[b] + 1.0) * big_t)))
    out = []
    for i, text in rows:
        own = runs(text, longest)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))))
    able = sorted((-r[3], r[0] is None, r[0] or 0) for r, (_, text) in zip(out, rows, strict=True) if len(words_of(text)) >= least)
    return out, able[: percent * len(able) // 100]


def check(got, rows, target, **options):
    want, drawn = slow(rows, target, **options)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == drawn


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 50)])
def test_against_brute_force(spark, table, longest, percent):
    rows = [(r.doc_id, r.text) for r in table.collect()] + [(None, "no id " * 30), (None, "no id " * 30), (4, "reused id, " * 40), (-1, None), (-2, "")]
    target = [f"item {i} of the test and the ting in re nd ou {i * i}" for i in range(50)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    check(rs.scored(docs, wanted, percent=percent, longest=longest).collect(), rows, target, percent=percent, longest=longest)


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    text = ("Ab9 c-d é日 " * 300 + "x" * 90).encode()
    whole = [(n, Counter(f)) for n, f in rs.features(text, 3)]
    monkeypatch.setattr(rs, "PIECE", 40)
    parts = list(rs.features(text, 3))
    assert len(parts) > 10 and len(whole) == 1
    assert (sum(n for n, _ in parts), sum((Counter(f) for _, f in parts), Counter())) == whole[0]


def test_odd_tables(spark, docs, small, nothing):
    target = spark.createDataFrame([("The quick brown fox",)], "text string")
    assert rs.scored(nothing, target).count() == 0 and rs.resample(nothing, target).count() == 0
    none = target.where("false")
    check(rs.scored(docs, none, percent=100).collect(), [(r[0], r[1]) for r in small], [], percent=100)
    got = rs.resample(docs, target, percent=50)
    assert got.columns == docs.columns
    _, drawn = slow([(r[0], r[1]) for r in small], ["The quick brown fox"], percent=50)
    assert Counter(r.doc_id for r in got.collect()) == Counter(d[2] for d in drawn)
    one = docs.where("doc_id = 10").drop("block").withColumn("own_row", docs.doc_id).withColumn("row", docs.doc_id).withColumn("score", docs.doc_id)
    assert rs.resample(one, target, percent=100).columns == one.columns


def test_all_rows_equal(spark):
    """Ties of score and id: as many as the share says."""
    docs = spark.range(400).selectExpr("bigint(7) as doc_id", "repeat('word ', 30) as text").repartition(4)
    got = rs.scored(docs, docs.limit(1)).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 41)) and len(got) == 400
