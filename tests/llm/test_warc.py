from hashlib import sha1

import pytest

from weftgraph.llm import warc
from weftgraph.llm.common import scratch

SCHEMA = "page_id long, url string, html string, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a.example/é x", big, "clash"), (5, None, big, ""), (3, "u", big, ""), (2, "u", "tiny", ""), (4, "u", "tiny", ""), (6, "u", None, ""), (7, "u", "", ""), (8, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 2000, ""), (9, "u", "z" * 999, ""), (10, "u", "z" * 999, ""), (11, "u", "q" * 100_000, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def expected(rows):
    out = []
    for page_id, html in rows:
        data = (html or "").encode()
        largest = max(p for p, h in rows if (h or "") == (html or ""))
        again = len(data) >= 1000 and largest != page_id
        out.append((page_id, len(data), sha1(data).hexdigest(), "revisit" if again else "response", largest if again else None))
    return sorted(out)


def test_round_trip(spark, pages):
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert sorted(map(tuple, warc.report(pages).collect())) == expected(rows)
    path = scratch(spark, "w")
    warc.write_archives(pages, path, segment_bytes=300)
    read = warc.read_archives(spark, path).collect()
    html = dict(rows)
    for r in read:
        assert r.whole
        if r.record_type == "response":
            assert bytes(r.payload).decode() == (html[r.page_id] or "")


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert sorted(map(tuple, warc.report(pages).collect())) == expected([(r.page_id, r.html) for r in pages.collect()])


def test_broken_segments(spark, tmp_path):
    def segments(page_id, payload):
        return list(warc.records(page_id, "u", payload, None, 50))

    good, gap, short, twice = (segments(i, bytes([65 + i]) * 300) for i in range(4))
    del gap[2], short[-1]
    twice.append(twice[1])
    mixed = [x for group in (good[::-1], gap, short, twice) for x in group]  # in any order
    (tmp_path / "part-1.txt").write_bytes(b"".join(x + b"\r\n\r\n" for x in mixed[::2]))
    (tmp_path / "part-2.txt").write_bytes(b"".join(x + b"\r\n\r\n" for x in mixed[1::2]))
    got = {r.page_id: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert got[0].whole and bytes(got[0].payload) == b"A" * 300
    assert not any(got[i].whole or got[i].payload for i in (1, 2, 3))


def test_chunked():
    for body in (b"", b"a", b"\r\n0\r\n\r\n" * 5000):
        assert warc.dechunked(warc.chunked(body, 7)) == body
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"1\r\na\r\n", b"0\r\n\r\nmore"):
        assert warc.dechunked(broken) is None


def test_empty(spark):
    assert warc.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    """Each row comes back, of whatever size: equal rows, one page_id with other html, null page_ids."""
    long, half, short = "a" * 30_000, "b" * 9_000, "tiny"
    rows = [(1, "u", long, ""), (1, "u", long, ""), (1, "v", long, ""), (2, "u", short, ""), (2, "u", short, ""), (3, "u", half, ""), (3, "u", "c" * 20_000, ""), (4, "u", half, ""), (4, "u", half, "")]
    rows += [(None, "u", "d" * 20_000, ""), (None, "u", "d" * 20_000, ""), (None, "u", half, ""), (None, None, None, ""), (-7, "u", "e" * 20_000, "")]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)

    def one(page_id, html):
        data = (html or "").encode()
        largest = max((p for p, _, h, _ in rows if h == html and p is not None), default=None)
        again = len(data) >= 1000 and largest not in (None, page_id)
        return page_id, len(data), sha1(data).hexdigest(), "revisit" if again else "response", largest if again else None

    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, warc.report(pages).collect()), key=order) == sorted((one(r[0], r[2]) for r in rows), key=order)
    path = scratch(spark, "w")
    warc.write_archives(pages, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).collect()
    fields = [f for r in files for f in warc.parse_records(warc.gzip.decompress(r.content))]
    ids = [f[0] for f in fields]
    assert len(ids) == len(set(ids))
    named = {x for r in files for x in warc.gzip.decompress(r.content).decode().split("WARC-Refers-To: ")[1:]}
    assert named and {x.split("\r\n")[0] for x in named} <= {f[0] for f in fields if f[2] == "response"}


def test_damaged_archives(spark, tmp_path):
    """Whatever is wrong with a record, the others are read; a record that isn't as stated is not whole."""
    one = lambda i, html, size=8192: [r + warc._END for r in warc.records(i, "u", html, None, size)]
    good, short, forged, lengthless, odd = (b"".join(one(i, b"payload %d " % i * 20)) for i in range(1, 6))
    forged = forged.replace(b"payload 3 pay", b"payload 9 pay", 1)
    lengthless = lengthless.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x", 1)
    odd = odd.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:!", 1).replace(b"WARC-Payload-Length: ", b"WARC-Payload-Length: z", 1).replace(b"<urn:page:5:", b"<urn:page:five:", 1)
    parts = one(6, b"cut " * 5000, 4096)
    (tmp_path / "a.txt").write_bytes(good + forged + lengthless + odd + b"".join(parts[:2] + parts[3:]) + short[:-60])
    (tmp_path / "b.txt.gz").write_bytes(warc.gzip.compress(b"".join(one(7, b"late " * 5000, 4096)[::-1])))
    got = {r.page_id: (r.whole, None if r.payload is None else len(r.payload)) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {1: (True, 200), 2: (False, None), 3: (False, None), 4: (False, None), None: (True, 200), 6: (False, None), 7: (True, 25_000)}


def _one(i, html, size=8192):
    return b"".join(r + warc._END for r in warc.records(i, "u", html, None, size))


def _read(spark, path):
    return {r.page_id: (r.whole, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(spark, str(path)).collect()}


def test_foreign_archives(spark, tmp_path):
    """Version 1.0, .warc and .warc.gz, a gzip member for each record, trailers, bodies without framing."""
    plain = {i: b"page %d " % i * 30 for i in range(1, 9)}
    old = b"".join(_one(i, plain[i]) for i in (1, 2)).replace(b"WARC/1.1\r\n", b"WARC/1.0\r\n")
    (tmp_path / "old.warc").write_bytes(old + b"\r\n")
    (tmp_path / "each.warc.gz").write_bytes(b"".join(warc.gzip.compress(_one(i, plain[i])) for i in (3, 4)) + b"\0" * 20)
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(plain[5], 11)[:-2] + b"Expires: never\r\nX-Sum: 1\r\n\r\n"
    unframed = b"HTTP/1.1 200 OK\r\n\r\n" + plain[6]
    made = b"".join(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d:x>\r\nContent-Length: %d\r\n\r\n" % (i, len(x)) + x + warc._END for i, x in ((5, body), (6, unframed)))
    (tmp_path / "made.warc.gz").write_bytes(warc.gzip.compress(made))
    broken = bytearray(warc.gzip.compress(_one(7, plain[7])))
    broken[40:60] = b"\xff" * 20
    (tmp_path / "broken.warc.gz").write_bytes(bytes(broken) + warc.gzip.compress(_one(8, plain[8])))
    got = _read(spark, tmp_path)
    got.pop(7, None)
    got.pop(None, None)
    assert got == {i: (True, plain[i]) for i in (1, 2, 3, 4, 5, 6, 8)}


@pytest.mark.parametrize("by", [b"9", b"-", b"1"])
def test_wrong_lengths(by):
    """Of three records three come out, whichever states a wrong length."""
    good = [_one(i, b"payload %d " % i * 20) for i in range(3)]
    for wrong in range(3):
        parts = list(good)
        parts[wrong] = parts[wrong].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: " + by, 1)
        assert [(r[1], r[-2]) for r in warc.parse_records(b"".join(parts))] == [(i, i != wrong) for i in range(3)]
        at = parts[wrong].index(b"\r\nContent-Length: ") + 18
        parts[wrong] = good[wrong][:at] + b"7" + good[wrong][good[wrong].index(b"\r\n", at) :]
        assert [(r[1], r[-2]) for r in warc.parse_records(b"".join(parts))] == [(i, i != wrong) for i in range(3)]


def test_long_page_and_hot_digest(spark, monkeypatch):
    """A page of 20 MB whose segments span files; one boilerplate page under most ids."""
    import weftgraph.llm.common as common

    monkeypatch.setattr(common, "FEW", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = [(1, "u", "long page " * 2_000_000, "")] + [(i, "u", "boilerplate " * 100, "") for i in range(2, 60)] + [(i, "u", "own %d " % i * 300, "") for i in range(60, 70)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, warc.report(pages).collect())) == expected([(r[0], r[2]) for r in rows])
