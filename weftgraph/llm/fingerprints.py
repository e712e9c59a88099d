"""Lempel-Ziv phrase fingerprints.

A document is parsed into Lempel-Ziv (1978) dictionary phrases; the fingerprint
is a minimum-hash signature of the phrase set, so that the share of equal slots
estimates the Jaccard likeness of two phrase dictionaries: texts that would
compress each other well share phrases.

Null text counts as empty. Two texts without phrases are alike (1.0); a text
without phrases and one with phrases are not (0.0). Repeated rows have equal
fingerprints; an empty table gives an empty result. A text is parsed whole, one
at a time: a worker holds its phrases besides a slice of ``SLICE_BYTES``. A
column called ``fingerprint`` gets an underscore more; other columns are kept
(``fingerprints``) or not read (``edited_fingerprints``).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, block_ids, shuffle_partitions, slices

SLOTS = 128
#: Documents of a run, which is sorted in one task, and the most runs: their bounds and heads are broadcast.
RUN_ROWS, MOST_RUNS = 500, 65_536
#: Ids a run that the bounds are read from.
SAMPLED = 20
#: Characters of a text that bound a run of rows which share their id.
HEAD = 32

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20_240_501))
_MULTIPLY = (_rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_EMPTY = np.full(SLOTS, 0xFFFFFFFF, np.uint32)


def parse(text: str, start: int, phrases: dict[str, None] | set[str], ends: list[int], add) -> int:
    """Lempel-Ziv parse of ``text`` from ``start`` on; adds phrases and their ends.

    The dictionary holds every prefix of its phrases, so the shortest new phrase
    is looked for from the length of the phrase before, up or down. Returns
    where the rest begins that is no new phrase.
    """
    n, size = len(text), 3
    while start < n:
        stop = min(start + size, n)
        piece = text[start:stop]
        if piece in phrases:
            while stop < n:
                stop += 1
                piece = text[start:stop]
                if piece not in phrases:
                    break
            else:
                return start
        else:
            while stop - start > 1:
                shorter = text[start : stop - 1]
                if shorter in phrases:
                    break
                piece = shorter
                stop -= 1
        add(piece)
        ends.append(stop)
        size = stop - start
        start = stop
    return start


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        for i, root in enumerate((_ROOT, _INVERSE)):
            table = np.full(size, root, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def phrase_hashes(text: str, start: int, ends: list[int]) -> np.ndarray:
    """32-bit hashes of the consecutive phrases from ``start`` on."""
    if not ends:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text[start : ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = _power_tables(len(points))
    total = np.concatenate([[np.uint64(0)], np.cumsum((points + np.uint64(1)) * up[: len(points)], dtype=np.uint64)])
    at = np.asarray(ends, np.int64) - start
    begin = np.concatenate([[0], at[:-1]])
    h = (total[at] - total[begin]) * down[begin]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each slot's permutation over the hashes."""
    least = _EMPTY.copy()
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        values = _MULTIPLY[:, None] * part[None, :]
        values += _ADD[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def _short(least: np.ndarray) -> np.ndarray:
    """16 well-mixed bits a slot."""
    x = least ^ (least >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x = x * np.uint32(0xC2B2AE35)
    return (x >> np.uint32(16)).astype(">u2")


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text."""
    phrases: dict[str, None] = {}
    ends: list[int] = []
    parse(text or "", 0, phrases, ends, lambda p: phrases.setdefault(p))
    return _short(signature(phrase_hashes(text or "", 0, ends))).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1."""
    return _alike(np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2"))


_NOTHING = _short(_EMPTY)


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    none = [bool((x == _NOTHING).all()) for x in (a, b)]
    if any(none):
        return float(all(none))
    by_chance = 1 / 65_536
    return max(0.0, (float((a == b).mean()) - by_chance) / (1 - by_chance))


class Parsed:
    """A document with its parse."""

    def __init__(self, text: str):
        self.text = text
        self.phrases: dict[str, None] = {}
        self.ends: list[int] = []
        self.rest = parse(text, 0, self.phrases, self.ends, lambda p: self.phrases.setdefault(p))
        self.hashes = phrase_hashes(text, 0, self.ends)
        self.least = signature(self.hashes)
        self.short = _short(self.least)

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """This text with its last third replaced by the head of another, and its fingerprint.

        The parse of the part that stays is not repeated.
        """
        third = len(self.text) // 3
        keep = len(self.text) - third
        text = self.text[:keep] + other[:third]
        known = bisect.bisect_right(self.ends, keep)
        start = self.ends[known - 1] if known else 0
        phrases, ends = set(islice(self.phrases, known)), []
        parse(text, start, phrases, ends, phrases.add)
        least = np.minimum(signature(self.hashes[:known]), signature(phrase_hashes(text, start, ends)))
        return text, _short(least)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with a column ``fingerprint``; needs no shuffle."""
    docs = aside(docs, "fingerprint")
    schema = docs.select("*", F.lit("").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.append_column("fingerprint", pa.array([fingerprint(x) for x in part.column(text).to_pylist()], pa.string()))

    return docs.mapInArrow(run, schema)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and likeness to that and to the next document.

    The next document is the one before in ascending ``doc_id``; after the last
    comes the first. Null ids come last, ties are ordered by text. Each run of
    the order is one sorted task; its bounds are quantiles of the ids, so runs are
    about equal however the ids lie. An id (null too) that more rows share than
    two runs hold is bounded by the heads of its texts besides, and repeated rows
    of an Arrow batch go as one row with a count, so such an id is no task of its
    own. The document that the next run starts with is sent along with a run, so
    no task sees more than its run.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.select(F.count(F.lit(1))).first()[0]
    runs = max(1, min(MOST_RUNS, n // RUN_ROWS))
    bounds = _bounds(docs, n, runs) if runs > 1 else []
    shared = any(head for *_, head in bounds)
    width = shuffle_partitions(spark)
    named = block_ids((len(bounds) + 1) // width + 1, width)  # runs are dealt evenly
    known = spark.sparkContext.broadcast((bounds, named))

    @F.arrow_udf("int")
    def run_of(ids: pa.Array, heads: pa.Array) -> pa.Array:
        bounds, named = known.value
        at = [bisect.bisect_right(bounds, _place(i, h)) for i, h in zip(ids.to_pylist(), heads.to_pylist(), strict=True)]
        return pa.array(named[np.asarray(at, np.int64)], pa.int32())

    head = F.substring("text", 1, HEAD) if shared else F.lit("")
    rows = docs.withColumn("head", head).withColumn("run", run_of("doc_id", "head"))
    place = {int(x): i for i, x in enumerate(named)}
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("turn"), "head")).alias("at")
    heads = sorted(rows.groupBy("run").agg(first).collect(), key=lambda r: place[r["run"]])
    after = [(heads[i - 1]["run"], None if h["at"]["none"] else ~h["at"]["turn"], h["at"]["head"]) for i, h in enumerate(heads)]  # the run before needs this head
    sent = F.broadcast(spark.createDataFrame(after, "run int, id long, start string"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("head") == F.col("start"))
    late = docs.withColumn("head", head).join(sent, same).groupBy("run", "doc_id").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "text", "run", F.lit(0).alias("late"), F.lit(1).cast("long").alias("times"))
    if shared:
        rows = rows.mapInArrow(_folded, rows.schema)
    rows = rows.unionByName(late.select("doc_id", "text", "run", F.lit(1).alias("late"), F.lit(1).cast("long").alias("times")))
    rows = rows.repartition("run").sortWithinPartitions("run", "late", F.col("doc_id").desc_nulls_last(), "text")
    found = rows.mapInArrow(
        _compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long",
    )
    return found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


def _place(doc_id: int | None, head: str) -> tuple[bool, int, str]:
    """Where a row stands: larger ids first, null ids last, then by text."""
    return doc_id is None, 0 if doc_id is None else ~doc_id, head


def _bounds(docs: DataFrame, n: int, runs: int) -> list[tuple[bool, int, str]]:
    """Places that runs start with; they decide which rows meet in a task, not what comes out."""
    # Ids of some hashes tell where runs end, all ids are counted to find those that many rows share.
    every = n // (SAMPLED * runs)
    sampled = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, every))) == 0)).distinct()
    ids = np.sort(np.asarray(sampled.toArrow().column("doc_id").combine_chunks(), np.int64))
    out = {(True, 0, "")} | {_place(int(i), "") for i in ids[(np.arange(1, runs) * len(ids)) // runs]} if len(ids) else {(True, 0, "")}
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * runs > 2 * n)  # fewer than runs / 2 of them
    sizes = {r.doc_id: r.n for r in shared.collect()}
    if sizes:
        few = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sizes], "id long"))
        heads = docs.join(few, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", F.substring("text", 1, HEAD).alias("head"))
        heads = heads.where(F.pmod(F.xxhash64("head"), F.lit(max(1, 4 * every))) == 0).distinct()
        by: dict[int | None, list[str]] = {i: [] for i in sizes}
        for i, h in heads.collect():
            by[i].append(h)
        for i, many in by.items():
            many.sort()
            cuts = sizes[i] * runs // n
            out |= {_place(i, "")} | {_place(i, many[k * len(many) // cuts]) for k in range(1, cuts) if many}
    return sorted(out)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one, with their number in ``times``."""
    for batch in batches:
        for part in slices(batch, "text"):
            yield from pa.Table.from_batches([part]).group_by(["doc_id", "text", "run", "late"]).aggregate([("times", "sum")]).rename_columns(part.schema.names).to_batches()


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("times", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: tuple[int | None, Parsed, int] | None = None

    def met(doc_id: int | None, own: Parsed, other: Parsed, times: int) -> tuple:
        edited, short = own.edited(other.text)
        return (doc_id, len(own.text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.short.tobytes().hex(), short.tobytes().hex(), _alike(own.short, short), _alike(own.short, other.short), times)

    for batch in batches:
        for part in slices(batch, "text"):
            out: list[tuple] = []
            for doc_id, text, late, times in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "late", "times")), strict=True):
                if late and waiting is None:
                    continue  # ties of the head: the first served
                parsed = waiting[1] if waiting is not None and waiting[1].text == text else Parsed(text)
                if waiting is not None:
                    own_id, own, copies = waiting
                    if copies > 1:  # all but the last are followed by themselves
                        out.append(met(own_id, own, own, copies - 1))
                    out.append(met(own_id, own, parsed, 1))
                waiting = None if late else (doc_id, parsed, times)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
