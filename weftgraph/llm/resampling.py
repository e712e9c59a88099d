"""Importance resampling towards a target distribution, over hashed word runs.

A document's features are its runs of 1 to ``longest`` consecutive words, joined
by one space, repeats counted; words are runs of letters and digits, A-Z in
lower case. A feature's bucket is the crc32 of its bytes modulo ``buckets``.

Two passes over the texts, both in Arrow batches. The first counts buckets with
``np.bincount``: each partition gives one vector, and ``treeReduce`` adds these
up, for the documents and for the target texts. The gain of a bucket is the log
ratio of its smoothed shares in target and documents, in floored thousandths.
The second pass gathers the gains, which are broadcast (one number a bucket,
whatever the data), and sums them by document with ``np.bincount`` weights. The
sums are whole numbers, so no order of adding changes them.

The weight of a document is the floored mean of its gains. Adding Gumbel noise
from a seeded hash of its id and taking the highest scores draws without
replacement by weight. Scores are whole numbers between about -50,000 and 70,000
at any size, so a table of how many have each, which is small, gives the least
score that is drawn; only rows from it on are sorted, by range, never in one
task.

Null texts, and texts without a word, have no feature and weight 0; a null id
reads as an empty one. Rows that share an id, and repeated rows, have the same
noise and count apart; where score and id tie, an arbitrary but fixed one of the
rows comes first. Without target texts gains favour what is rare. An empty table
gives an empty result. Other columns, whatever their names, are not read
(``scored``) or come through as they are (``resample``). A long text is cut into
pieces of ``PIECE`` bytes at a word's end, so memory doesn't follow its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import chain
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, slices, spread, stored
from .mixing import ranked

BUCKETS = 10_000
#: The longest run of words that is a feature.
LONGEST = 1
#: Per cent of the documents with LEAST_WORDS words or more that are drawn.
PERCENT, LEAST_WORDS = 10, 20
SEED = 2024
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: What no word has becomes a space, A-Z their small letters.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of one piece after the other."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def features(text: bytes, longest: int = LONGEST) -> Iterator[tuple[int, list[bytes]]]:
    """How many words a piece of the text has, and the runs that end in it."""
    before: list[bytes] = []
    for words in _pieces(text.translate(_PLAIN)):
        out = list(words)
        every = before + words
        for n in range(2, longest + 1):
            out += [b" ".join(every[i : i + n]) for i in range(max(0, len(before) - n + 1), len(every) - n + 1)]
        yield len(words), out
        before = every[len(every) - longest + 1 :] if longest > 1 else []


def _hashed(texts: list[bytes | None], buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the features of some texts, each one's text, and words by text; a part of about ``PIECE`` bytes after the other."""

    def done(part: list[tuple[int, int, list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(f) for _, _, f in part], np.int64)
        of = np.repeat(np.array([i for i, _, _ in part], np.int64), sizes)
        hashes = np.fromiter(map(zlib.crc32, chain.from_iterable(f for _, _, f in part)), np.uint32, int(sizes.sum()))
        words = np.bincount([i for i, _, _ in part], weights=[n for _, n, _ in part], minlength=len(texts)).astype(np.int64)
        return (hashes % np.uint32(buckets)).astype(np.int64), of, words

    part, held = [], 0
    for i, text in enumerate(texts):
        for n, found in features(text or b"", longest):
            part.append((i, n, found))
            held += len(found)
            if held * 8 > PIECE:
                yield done(part)
                part, held = [], 0
    if part:
        yield done(part)


def _counting(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for at, _, _ in _hashed(part.column("text").to_pylist(), buckets, longest):
                    total += np.bincount(at, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def _added(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()


def counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    vectors = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_counting(buckets, longest), "counts binary")
    none = texts.sparkSession.sparkContext.parallelize([bytes(8 * buckets)], 1)
    return np.frombuffer(vectors.rdd.map(lambda r: bytes(r.counts)).union(none).treeReduce(_added), np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's smoothed shares."""
    n = len(source)
    more, most = float(source.sum() + n), float(target.sum() + n)
    return np.array([floor(1000 * log((t + 1.0) * more / ((s + 1.0) * most))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighing(own, buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = own.value
        for batch in batches:
            for part in slices(batch, "text"):
                n = np.zeros(part.num_rows, np.int64)
                words, sums = np.zeros_like(n), np.zeros(part.num_rows)
                for at, of, more in _hashed(part.column("text").to_pylist(), buckets, longest):
                    n += np.bincount(of, minlength=len(n))
                    sums += np.bincount(of, weights=gain[at], minlength=len(n))  # whole numbers below 2 ** 53
                    words += more
                weight = np.where(n > 0, sums.astype(np.int64) // np.maximum(n, 1), 0)
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(n), pa.array(words), pa.array(weight)], names=[*kept, "n_features", "n_words", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in floored thousandths, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, own: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row, and its columns ``own``; rank is null for rows that aren't drawn."""
    source = spread(docs.select("doc_id", *own, F.col("text").cast("binary").alias("text")))
    gain = docs.sparkSession.sparkContext.broadcast(gains(counts(source, buckets, longest), counts(target, buckets, longest)))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *own))
    weighed = source.mapInArrow(_weighing(gain, buckets, longest), f"{kinds}, n_features long, n_words long, weight long")
    rows = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "scores")
    able = F.col("n_words") >= least_words
    by = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()  # about 120,000 rows at most
    order = np.argsort(-by.column("score").to_numpy(), kind="stable")
    score, upto = by.column("score").to_numpy()[order], np.cumsum(by.column("n").to_numpy()[order])
    drawn = percent * int(upto[-1]) // 100 if len(upto) else 0
    names = ["doc_id", *own, "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return rows.select(*names, none)
    near = able & (F.col("score") >= int(score[np.searchsorted(upto, drawn)]))
    first = ranked(rows.where(near), "place", F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("row"))
    place = F.when(F.col("place") < drawn, F.col("place") + 1)
    return first.select(*names, place.alias("rank")).unionByName(rows.where(~near).select(*names, none))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, in all their columns."""
    row, of = free([*docs.columns, "text", "row"], "own_row"), free(docs.columns, "own_of")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    drawn = scored(numbered.select("doc_id", "text", row), target, own=(row,), **options).where("rank is not null").select(F.col(row).alias(of))
    return numbered.join(drawn.hint("shuffle_hash"), F.col(row) == F.col(of), "left_semi").select(*docs.columns)
