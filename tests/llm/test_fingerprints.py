from hashlib import sha256

import numpy as np

from weftgraph.llm import fingerprints as fp


def slow_phrases(text):
    seen, start = [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.append(text[start:end])
            start = end
    return seen


def test_parse_is_lempel_ziv():
    for text in ("", "a", "aaaaaaa", "abracadabra abracadabra", "the cat the hat the bat " * 3, "日本日本日本語"):
        seen, ends = {}, []
        fp.parse(text, 0, seen, ends, lambda p: seen.setdefault(p))
        assert list(seen) == slow_phrases(text)
        assert ends == list(np.cumsum([len(p) for p in seen]))


def expected(rows):
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    out = []
    for i, (doc_id, text, *_) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        a, b, c = map(fp.fingerprint, (text, edited, other))
        out.append((doc_id, len(text), sha256(edited.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out)


def test_against_brute_force(docs, small, table, monkeypatch):
    got = sorted(map(tuple, fp.edited_fingerprints(docs).collect()))
    assert got == expected(small)
    monkeypatch.setattr(fp, "RUN_ROWS", 7)  # many runs
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    assert sorted(map(tuple, fp.edited_fingerprints(table).collect())) == expected(rows)


def test_null_ids_come_last(spark):
    rows = [(None, "last text of all"), (2, "second text"), (9, "first text")]
    got = {r.doc_id: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].edited_sha256 == sha256(b"second t" + b"las").hexdigest()
    assert got[None].edited_sha256 == sha256(b"last text o" + b"first").hexdigest()


def test_likeness_follows_jaccard():
    rng = np.random.default_rng(1)
    words = ["w%d" % i for i in range(400)]
    a = " ".join(rng.choice(words, 3000))
    b = a[: len(a) // 2] + " ".join(rng.choice(words, 1500))
    x, y = set(slow_phrases(a)), set(slow_phrases(b))
    assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - len(x & y) / len(x | y)) < 0.13
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(a)) == 1.0
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("")) == 1.0
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("a")) == 0.0


def test_empty_table_and_general_form(nothing, docs, small):
    assert fp.edited_fingerprints(nothing).count() == 0
    got = {(r.doc_id, r.text): r.fingerprint for r in fp.fingerprints(docs).collect()}
    assert got == {(r[0], r[1]): fp.fingerprint(r[1]) for r in small}


def test_shared_ids_spread_over_tasks(spark, monkeypatch):
    """Half of the ids null or equal, repeated rows among them: same results, and no run with more than a few times its share."""
    monkeypatch.setattr(fp, "RUN_ROWS", 50)
    for shared in (None, 7):
        rows = [(shared if i % 2 else i, f"{i * 7919 % 1000} text of document {i}" if i % 8 < 6 else "a copy") for i in range(1600)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        bounds = fp._bounds(docs, len(rows), 32)
        distinct = set(rows)
        held = np.bincount([int(np.searchsorted(range(len(bounds)), fp.bisect.bisect_right(bounds, fp._place(i, t[: fp.HEAD])))) for i, t in distinct])
        assert len(bounds) > 20 and held.max() < 5 * len(distinct) / len(bounds)
        if shared is None:
            got = sorted(map(tuple, fp.edited_fingerprints(docs).collect()), key=repr)
            order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
            want = []
            for i, (doc_id, text) in enumerate(order):
                other, third = order[(i + 1) % len(order)][1], len(text) // 3
                edited = text[: len(text) - third] + other[:third]
                a, b, c = map(fp.fingerprint, (text, edited, other))
                want.append((doc_id, len(text), sha256(edited.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
            assert got == sorted(want, key=repr)
