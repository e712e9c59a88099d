from collections import Counter
from zlib import crc32

import pytest

from weftgraph.llm import sharding as sh
from weftgraph.llm.common import scratch


@pytest.mark.parametrize("bucket_bytes", [400, 1 << 24])
def test_every_row_once(spark, docs, small, bucket_bytes):
    read = sh.shard(docs, scratch(spark, "t"), shards=5, bucket_bytes=bucket_bytes)
    rows = read.collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r[0], r[1] or "") for r in small)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(5)) <= 1
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    again = sh.shard(docs.repartition(7), scratch(spark, "t"), shards=5, bucket_bytes=bucket_bytes).collect()
    key = lambda r: (r.doc_id, r.text or "", r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_report(docs, small, nothing, table):
    got = {(r.doc_id, r.text_crc32): r for r in sh.report(docs).collect()}
    for doc_id, text, *_ in small:
        data = (text or "").encode()
        r = got[doc_id, crc32(data)]
        assert (r.size, r.law, r.grown_shard) == (len(data) + 16, "rows", None)
    assert sh.report(nothing).count() == 0
    rows = sh.report(table).orderBy("doc_id").collect()
    assert len(rows) == 200 and Counter(Counter(r.shard for r in rows).values()) == {5: 40}
    # shuffled: neighbours by id are not neighbours by place
    places = [r.shard * 5 + r.slot for r in rows]
    assert sum(abs(a - b) == 1 for a, b in zip(places, places[1:])) < 20
