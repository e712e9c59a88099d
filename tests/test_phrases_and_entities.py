import json
import math
import random
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from weftgraph.functions.text import QUERY_STOPWORDS
from weftgraph.ingest import Phrases, Words, ingest
from weftgraph.operators import joins, phrases, resolve
from weftgraph.storage import stored

PLANTED = ["solar inverter", "heat pump compressor", "copper busbar"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Words at random, planted phrases, stop words all over; a third of the texts alike, nulls and empty ones."""
    rng = random.Random(3)
    words = [f"w{i:02d}" for i in range(60)]
    texts = []
    for i in range(90):
        t = [rng.choice([*words, "the", "of"]) for _ in range(60)]
        t[10:10] = PLANTED[i % 3].split()
        t[40:40] = PLANTED[i % 2].split()
        texts.append(" ".join(t))
    texts += [texts[0]] * 30 + [None, "", "one", "two words"]
    return list(enumerate(texts)), spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)


def brute(texts, least, threshold, longest):
    out = {}
    for size in range(2, longest + 1):
        every = Counter()
        for t in texts:
            w = re.findall(r"[\w-]+", (t or "").lower())
            every.update((" ".join(w[i : i + size - 1]), w[i + size - 1]) for i in range(len(w) - size + 1))
        total, heads, lasts = sum(every.values()), Counter(), Counter()
        for (h, w), n in every.items():
            heads[h] += n
            lasts[w] += n
        for (h, w), n in every.items():
            r, c = heads[h], lasts[w]
            table = [(n, r, c), (r - n, r, total - c), (c - n, total - r, c), (total - r - c + n, total - r, total - c)]
            score = 2 * sum(x * math.log(x * total / (a * b)) for x, a, b in table if x)
            ends = [h.split(" ")[0], w]
            if n >= least and score >= threshold and n * total > r * c and all(len(e) >= 3 and e not in QUERY_STOPWORDS for e in ends):
                out[f"{h} {w}"] = (size, n, pytest.approx(score, abs=1e-5))
    return out


def test_phrases_like_brute_force(spark, corpus):
    rows, table = corpus
    got = {r.phrase: (r["size"], r.n, r.association) for r in phrases.phrases(table).collect()}
    assert got == brute([t for _, t in rows], 3, 10.83, 3)
    known = phrases.phrases(table)
    for r in phrases.key_phrases(table, known, "id", most=3).groupBy("id").count().collect():
        assert r["count"] <= 3
    assert phrases.phrases(table.where("false")).count() == 0


def test_annotator_finds_planted_phrases(spark, corpus, tmp_path):
    """Of the planted phrases of each text the tags have all; those of ``Words`` are single words, so they have none."""
    rows, table = corpus
    found = {True: 0, False: 0}
    made = Phrases().table(table.withColumnRenamed("id", "chunk_id"), table.withColumnRenamed("id", "chunk_id"))
    tags = {r.chunk_id: set(json.loads(r.annotation)["tags"]) for r in made.collect()}
    assert len(tags) == len(rows)
    wanted = {i: {p for p in PLANTED if t and p in t} for i, t in rows}
    for i, t in rows:
        found[True] += len(wanted[i] & tags[i])
        found[False] += len(wanted[i] & set(Words().annotate([t or ""])[0]["tags"]))
    assert found == {True: sum(map(len, wanted.values())), False: 0}


def test_ingest_with_phrases(spark, corpus, tmp_path):
    rows, table = corpus
    manifest = table.selectExpr("concat('d', id) AS doc_id", "'t' AS title", "concat('f', id) AS file_path", "array('k') AS keywords", "text")
    graph = ingest(manifest, f"file://{tmp_path}/cache", "2024-01-01", Phrases())
    names = {r.name for r in graph["tags"].collect()}
    assert set(PLANTED) <= names
    again = ingest(manifest, f"file://{tmp_path}/cache", "2024-01-02", Phrases())  # all from the cache
    assert {r.name for r in again["tags"].collect()} == names


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


MENTIONS = [("Berlin", "CITY")] * 3 + [("Berlim", "CITY"), ("Berlime", "CITY"), ("berlin ", "CITY"), ("Berlin", "SHIP"), ("Rome", "CITY"), ("Rom", "CITY"), ("Zürich", "CITY"), ("Zurich", "CITY"), ("  ", "CITY"), (None, "CITY"), ("loose", "UNKNOWN"), ("loosen", None), ("New  York", "CITY"), ("new york", "CITY"), ("new yorks", "CITY")]


def test_members_like_brute_force(spark):
    table = spark.createDataFrame(MENTIONS * 2, "name string, type string").repartition(3)
    counts = Counter((" ".join(n.split()).lower(), t) for n, t in MENTIONS * 2 if n and n.strip() and t not in (None, "UNKNOWN"))
    group = {k: {k} for k in counts}
    for a, b in combinations(counts, 2):
        if a[1] == b[1] and min(len(a[0]), len(b[0])) >= resolve.SHORT and edit_one(a[0], b[0]):
            joined = group[a] | group[b]
            for k in joined:
                group[k] = joined
    want = {k: (n, min(group[k], key=lambda x: (-counts[x], x[0]))[0], sum(counts[x] for x in group[k])) for k, n in counts.items()}
    got = {(r.name, r.type): (r.n, r.entity, r.of_entity) for r in resolve.entities(table).collect()}
    assert got == want


def test_ends_are_resolved(spark):
    members = resolve.entities(spark.createDataFrame(MENTIONS, "name string, type string"))
    relations = [("BERLIN", "UNKNOWN", "zürich", "CITY", 1), ("Berlinn", "UNKNOWN", "nowhere", "UNKNOWN", 2), ("loose", "UNKNOWN", "zurich", None, 3), (None, "UNKNOWN", "rom", "UNKNOWN", 4), ("Berlin", "SHIP", "Berlin", "UNKNOWN", 5), ("BERLIN", "UNKNOWN", "zürich", "CITY", 1)]
    got = resolve.resolve_ends(spark.createDataFrame(relations, "source string, source_type string, target string, target_type string, n int"), members).collect()
    assert sorted(map(tuple, got), key=lambda r: r[4]) == [
        ("berlin", "CITY", "zürich", "CITY", 1), ("berlin", "CITY", "zürich", "CITY", 1), ("berlin", "CITY", "nowhere", "UNKNOWN", 2), ("loose", "UNKNOWN", "zurich", "CITY", 3), (None, "UNKNOWN", "rom", "CITY", 4), ("Berlin", "SHIP", "berlin", "CITY", 5),
    ]


def test_no_mentions(spark):
    none = spark.createDataFrame([], "name string, type string")
    assert resolve.entities(none).count() == 0
    assert resolve.resolved(none, resolve.entities(none)).count() == 0


def test_sequences_are_cut_before_the_shuffle(spark, corpus, monkeypatch):
    """Slices of one row give the counts of whole batches; no row of a sequence that begins with a stop word, or of a longest one that ends with one, leaves a slice."""
    monkeypatch.setattr(phrases, "SLICE_BYTES", 1)
    rows, _ = corpus
    words = [" ".join(re.findall(r"[\w-]+", (t or "").lower())) for _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["words"])
    got = Counter()
    for part in phrases._counted(3)([batch]):
        for r in part.to_pylist():
            got[r["kind"], r["seq"]] += r["n"]
    content = lambda w: len(w) >= 3 and w not in QUERY_STOPWORDS
    want = Counter()
    for t in words:
        w = t.split()
        want.update((size, " ".join(w[i : i + size])) for size in (1, 2, 3) for i in range(len(w) - size + 1) if content(w[i]) and (size < 3 or content(w[i + 2])))
        want.update((-size, x) for size in (2, 3) for x in w[size - 1 :] if content(x))
        want.update({(0, str(size)): max(0, len(w) - size + 1) for size in (2, 3)})
    assert +got == +want


@pytest.mark.parametrize("bound", [4, 200_000])
def test_key_phrases_of_looked_up_and_other_rows(spark, corpus, monkeypatch, bound):
    """The best of each row, whether they are among the broadcast ones or not; rows of one key, or of none, are one."""
    monkeypatch.setattr(phrases, "MOST_BROADCAST", bound)
    rows, table = corpus
    known = {r.phrase: r.association for r in phrases.phrases(table).collect()}
    assert len(known) > 4
    keyed = [(None if i % 10 == 9 else i - i % 10 if i % 10 < 2 else i, t) for i, t in rows]
    want = {}
    for i, t in keyed:
        w = re.findall(r"[\w-]+", (t or "").lower())
        want.setdefault(i, set()).update(p for size in (2, 3) for j in range(len(w) - size + 1) if (p := " ".join(w[j : j + size])) in known)
    want = {(i, place, p, known[p]) for i, own in want.items() for place, p in enumerate(sorted(own, key=lambda p: (-known[p], p))[:2], 1)}
    got = phrases.key_phrases(spark.createDataFrame(keyed, "id long, text string").repartition(3), phrases.phrases(table), "id", most=2).collect()
    assert {(r.id, r.place, r.phrase, r.association) for r in got} == want and len(got) == len(want)


def test_names_of_a_variant_are_not_paired(spark, monkeypatch):
    """Twenty names of one place link as a star, not as 190 pairs; entities are those of all pairs, doubled letters and short names included."""
    seen = []
    monkeypatch.setattr(resolve, "components", lambda links: seen.append(links.distinct().count()) or joins.components(links))
    names = [f"besse{c}" for c in "abcdefghijklmnopqrst"]
    got = resolve.entities(spark.createDataFrame([(n, "X") for n in names], "name string, type string")).collect()
    assert seen[0] < 3 * len(names) and {r.of_entity for r in got} == {20}
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(3, 13))) for _ in range(150)})
    group = {w: {w} for w in words}
    for a, b in combinations(words, 2):
        if min(len(a), len(b)) >= resolve.SHORT and edit_one(a, b):
            joined = group[a] | group[b]
            for w in joined:
                group[w] = joined
    got = resolve.entities(spark.createDataFrame([(w, "X") for w in words], "name string, type string").repartition(3)).collect()
    assert {r.name: (r.entity, r.of_entity) for r in got} == {w: (min(group[w]), len(group[w])) for w in words}


def test_stars_take_no_round(spark, monkeypatch):
    """Links that are stars are done as they come."""
    names = []
    monkeypatch.setattr(joins, "stored", lambda df, name: names.append(name) or stored(df, name))
    got = joins.components(spark.createDataFrame([(0, i) for i in range(1, 9)] + [(20, 21)], "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(9)} | {(20, 20), (21, 20)} and len(got) == 11
    assert names == ["links"]


def test_ends_are_met_by_variant_only_where_open(spark, monkeypatch):
    """Relations are written once before each end; names that are typed themselves meet no variants; short names match as they are alone."""
    names = []
    monkeypatch.setattr(resolve, "stored", lambda df, name: names.append(name) or stored(df, name))
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(3, 10))) for _ in range(80)})
    members = spark.createDataFrame([(w, "XY"[i % 2], 1 + i % 3, f"e{i}", 1 + i % 5) for i, w in enumerate(words[::2])], "name string, type string, n long, entity string, of_entity long")
    known = {r.name: tuple(r) for r in members.collect()}
    want = {}
    for w in words:
        found = [(w != t, -m[4], -m[2], m[1], t, m[3]) for t, m in known.items() if w == t or min(len(w), len(t)) >= resolve.SHORT and edit_one(w, t)]
        want[w] = (min(found)[5], min(found)[3]) if found else (w, "UNKNOWN")
    rows = [(a, "UNKNOWN", b, "UNKNOWN", i) for i, (a, b) in enumerate(zip(words, reversed(words)))] + [("", "UNKNOWN", None, None, -1)]
    got = resolve.resolve_ends(spark.createDataFrame(rows, "source string, source_type string, target string, target_type string, n long"), members).collect()
    assert sorted(map(tuple, got), key=lambda r: r[4]) == [("", "UNKNOWN", None, None, -1)] + [(*want[a], *want[b], i) for a, _, b, _, i in rows[:-1]]
    assert names.count("ends") == 1 and names.count("relations") == 1
