"""Tables that are awkward in every way at once: clashing names, repeats, reused ids, long texts, extreme ids."""

from collections import Counter

import pytest

from weftgraph.llm import bpe, common, fingerprints, jaccard_join, language, lm_scoring, mixing, quality, sharding, token_counts
from weftgraph.llm.common import scratch
from weftgraph.llm.queries import vocabulary_path

CLASHES = "shard slot bucket place tie start own_bucket own_tie own_place own_start own_at copies of size draw cell rank position rate offset target mix_tie mix_row mix_of mix_copy mix_times _row key member component digest keys ids decoded block fingerprint run late held_out kind blob n".split()
LONG = "long text of many words, always others: " + " ".join(f"w{i * 7919}" for i in range(330_000))


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(2**63 - 1, "largest id"), (-(2**63), "smallest id"), (5, "one text"), (5, "another text"), (5, "one text"), (None, "no id"), (None, None), (7, ""), (8, LONG), (9, " \n")]
    rows += [(20, "the same row again and again")] * 30
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)
    for c in CLASHES:
        docs = docs.selectExpr("*", f"concat('{c}', '') as `{c}`")
    return docs.repartition(3), Counter(rows)


def texts(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_whole_tables_come_back(spark, awkward):
    docs, rows = awkward
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = sharding.shard(docs, scratch(spark, "t"), shards=4, bucket_bytes=2_000)
    assert got.columns == [*(f"{c}_" if c in ("shard", "slot") else c for c in docs.columns), "slot", "shard"]
    out = got.collect()
    assert texts(out) == rows and {r["shard_"] for r in out} == {"shard"}
    by = Counter(r["shard"] for r in out)
    assert max(by.values()) - min(by.values()) <= 1 and len({(r["shard"], r["slot"]) for r in out}) == len(out)
    got = fingerprints.fingerprints(docs)
    assert got.columns == [*(f"{c}_" if c == "fingerprint" else c for c in docs.columns), "fingerprint"] and texts(got.collect()) == rows
    got = quality.keep_good(docs, labels)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {8}
    assert language.keep_identified(docs).columns == docs.columns


def test_mixture_is_what_copies_say(awkward):
    docs, rows = awkward
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    said = Counter()
    for r in mixing.copies(docs, own=("text",)).collect():
        said[r.doc_id, r.text] += r.copies
    assert texts(mixed.collect()) == +said


def test_one_of_each_stays(awkward):
    docs, rows = awkward
    kept = jaccard_join.keep_one(docs, 80, 5)
    assert kept.columns == docs.columns
    assert texts(kept.collect()) == Counter({**dict.fromkeys(rows, 1)})


def test_reports_have_a_row_for_each(spark, awkward):
    docs, rows = awkward
    n, path = sum(rows.values()), vocabulary_path()
    want = Counter(i for i, _ in rows.elements())
    labels = spark.createDataFrame([(5, 1), (5, 0), (8, 1)], "doc_id long, quality int")
    frames = [
        fingerprints.edited_fingerprints(docs), quality.assess(docs, labels), language.identify(docs), jaccard_join.join(docs), bpe.digests(docs, path),
        sharding.report(docs), lm_scoring.score(docs), token_counts.counted(docs, path), mixing.report(docs),
    ]
    for df in frames:
        out = df.collect()
        assert len(out) == n and Counter(r.doc_id for r in out) == want, df.columns


def test_kept_columns_of_encoding(awkward):
    docs, rows = awkward
    got = bpe.encode(docs, vocabulary_path(), "doc_id", "text", "ids", "block", "decoded", decoded=True)
    assert got.columns == ["doc_id", "text", "ids_", "block", "decoded_", "ids", "decoded"]
    out = got.collect()
    assert texts(out) == rows and all(r["decoded"] == (r["text"] or "") and r["ids_"] == "ids" for r in out)


def test_links_of_reused_ids(spark):
    """One id on two texts: both texts' links count."""
    words = lambda p, n=60: [f"{p}{i}" for i in range(n)]
    base, other = words("a"), words("z")
    rows = [(5, " ".join(base)), (5, " ".join(other)), (8, " ".join(other + ["tail"])), (9, " ".join(base + ["tail"])), (3, " ".join(words("q")))]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 5), (5, 5), (8, 5), (9, 5)]


def test_sample_is_bounded_before_it_is_collected(spark):
    docs = spark.range(3000).selectExpr("bigint(7) as doc_id", "concat('row ', id, repeat(' word', 40)) as text")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert quality.fit(docs, labels).slope == 0.0
    assert quality.assess(docs, labels).count() == 3000


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 0)
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 0, id) as key", "id")
    rows = common.stored(rows, "rows")
    lookup = common.stored(rows.groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "key * 2 as twice"), "lookup")
    got = common.hot_join(rows, lookup, "key")
    assert got.count() == 20_000 and got.where("twice <> key * 2").count() == 0
