"""Language-model scoring by context-tree weighting over bytes.

The model is trained on the documents that are not held out and scores all. A
text is its lower-cased (A-Z) words, one space between them, then an end mark;
each byte is predicted from the ``DEPTH`` bytes before (see ``ctw``).

Everything the corpus gives flows through Spark in packed lists: a block of
documents (an input partition) states its distinct words and its distinct
grams (context and next byte) with their training counts; these are summed by
key, the trees are weighed, and each block gets back the counts and code
lengths of what it asked for, which it joins to its own documents. So memory
is bounded by a block and by a bucket of the model, not by the corpus. A bucket
holds all contexts with some two last bytes; the largest pair had 2 % of the
distinct grams when measured, which is the least that a task can work on.

A block is about ``BLOCK_BYTES`` of an input partition; blocks are dealt evenly to
tasks (``block_id``).

Null text is empty: just the end mark. Repeated rows count as often as they occur,
rows that share an id are scored each by its own text, null ids train. Without
training documents every bit costs one bit and every word is unknown. An empty
table gives an empty result; other columns, whatever their names, are not read.

The score tells texts that are unlike the corpus: code length per byte is high
for noise and foreign text, low for boilerplate that training has often. It does
not tell a text that occurs twice from one that occurs once: depth ``DEPTH`` sees
``DEPTH`` bytes, and the counts of those hardly change with one more copy.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ctw
from .common import MOST_BUCKETS, blocks, buckets_for, crc_mod, pack, release, shuffle_partitions, slices, spread, stored, texts, unpack

DEPTH = 6
END = b"\n"
#: Distinct grams and words that a task holds before it sends them on.
HELD_GRAMS, HELD_WORDS = 3_000_000, 300_000
#: Bytes of text whose grams are sorted at a time.
PART_BYTES = 1 << 20
#: Buckets of the model for each shuffle partition: a task works on one bucket at a time.
BUCKETS_EACH = 4
#: Grams looked up at a time.
LOOKS = 1 << 14

_ROWS = "kind int, block int, bucket int, blob binary"
_ROWS_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
#: Kinds of rows; lower ones come first where they meet.
MODEL, WORDS, GRAMS, DOCS = 0, 1, 2, 3


def _row(kind: int, block: int, bucket: int, table: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([bucket], pa.int32()), pa.array([pack(table)], pa.binary())], schema=_ROWS_ARROW)


def normalised(text: str) -> bytes:
    """Words in lower case, a space between them, and the end mark."""
    return b" ".join(text.encode("utf-8", "replace").lower().split()) + END


def gram_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the two last context bytes: all longer contexts of one meet."""
    two = (grams >> np.uint64(8 * (DEPTH - 1))).astype(np.uint32)
    return ((two * np.uint32(2_654_435_761)) >> np.uint32(8)).astype(np.int64) % buckets


def _planes(values: np.ndarray) -> pa.Array:
    """Numbers as one value, their bytes of equal weight side by side: these compress best."""
    return pa.array([np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()], pa.binary())


def gram_table(grams: np.ndarray, values: np.ndarray) -> pa.Table:
    """Sorted grams, as steps, and a number of each."""
    return pa.table({"steps": _planes(np.diff(grams, prepend=np.uint64(0))), "values": _planes(values)})


def gram_columns(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What ``gram_table`` was given; ``kind`` is the numbers' type."""
    steps, values = (np.ascontiguousarray(np.frombuffer(table.column(c)[0].as_py(), np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t).ravel() for c, t in (("steps", np.uint64), ("values", kind)))
    return np.cumsum(steps, dtype=np.uint64), values


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts by gram; sorted."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    if len(parts) == 1:
        return parts[0]
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at, dtype=counts.dtype) if len(at) else counts


def block_grams(docs: list[bytes], held_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of some documents and how often training documents have them."""
    pad = END * DEPTH
    keys = []
    for doc, held in zip(docs, held_out, strict=True):
        own = ctw.grams_of(np.frombuffer(pad + doc, np.uint8), DEPTH) << np.uint64(1)
        keys.append(own if held else own | np.uint64(1))
    flagged, counts = np.unique(np.concatenate(keys), return_counts=True)
    counts = np.where(flagged & np.uint64(1), counts, 0).astype(np.uint32)
    grams = flagged >> np.uint64(1)
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[at], np.add.reduceat(counts, at, dtype=counts.dtype)


def _ask(buckets: int, parts: int, width: int):
    """Documents, distinct words and distinct grams of each block."""

    def gram_rows(block: int, parts: list) -> Iterator[pa.RecordBatch]:
        grams, counts = _merge(parts)
        of = gram_bucket(grams, buckets)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own):
                yield _row(GRAMS, block, b, gram_table(grams[own], counts[own]))

    def word_rows(block: int, words: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for w in sorted(words):
            by.setdefault(crc32(w) % buckets, []).append(w)
        for b, own in by.items():
            yield _row(WORDS, block, b, pa.table({"word": pa.array(own, pa.binary()), "n": pa.array([words[w] for w in own], pa.int64())}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        block = None

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, words
            if block is not None:
                yield from word_rows(block, words)
                words = Counter()
                yield from gram_rows(block, held)
                held = []
                release()

        for of, part in blocks(batches, "block", parts, width, PART_BYTES):
            if of != block:
                yield from done()
                block = of
            docs = [normalised(t) for t in texts(part.column("text"))]
            out = np.asarray(part.column("held_out").to_pylist(), bool)
            yield _row(DOCS, block, 0, pa.table({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "text": pa.array(docs, pa.binary())}))
            seen: set[bytes] = set()
            for doc, x in zip(docs, out, strict=True):
                if x:
                    seen.update(doc.split())
                else:
                    words.update(doc.split())
            for w in seen:
                words.setdefault(w, 0)
            held.append(block_grams(docs, out))
            if 3 * sum(len(p[0]) for p in held[1:]) > HELD_GRAMS:  # held[0] is what has been merged
                held = [_merge(held)]
                if len(held[0][0]) > HELD_GRAMS:
                    yield from gram_rows(block, held)
                    held = []
            if len(words) > HELD_WORDS:
                yield from word_rows(block, words)
                words = Counter()
        yield from done()

    return run


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of a bucket's words over all blocks (words that occur in training only)."""
    counts: dict[bytes, int] = {}
    bucket = None

    def done() -> Iterator[pa.RecordBatch]:
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(counts)], pa.int64()), pa.array([sum(counts.values())], pa.int64()), pa.array([pack(pa.table({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}))], pa.binary())], names=["bucket", "distinct", "total", "blob"])

    for batch in batches:
        for of, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if of != bucket:
                yield from done()
                counts, bucket = {}, of
            table = unpack(blob.as_py())
            for w, n in zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True):
                if n:
                    counts[w] = counts.get(w, 0) + n
    yield from done()


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """log10(count + 1/2) of the words that each block asked for."""
    known: dict[bytes, float] = {}
    bucket = None
    unknown = math.log10(0.5)
    for batch in batches:
        for kind, block, of, blob in zip(*(batch.column(c) for c in ("kind", "block", "bucket", "blob")), strict=True):
            kind, block, of = kind.as_py(), block.as_py(), of.as_py()
            if of != bucket:
                known, bucket = {}, of
            table = unpack(blob.as_py())
            if kind == MODEL:
                values = np.log10(table.column("n").to_numpy() + 0.5).tolist()
                known.update(zip(table.column("word").to_pylist(), values, strict=True))
                continue
            logs = [known.get(w, unknown) for w in table.column("word").to_pylist()]
            yield _row(WORDS, block, of, pa.table({"word": table.column("word"), "log": pa.array(logs, pa.float64())}))


def _sum_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's training grams with their counts, and what its trees add to contexts of one byte."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    bucket, held = None, 0

    def done() -> Iterator[pa.RecordBatch]:
        grams, counts = _merge(parts)
        if not len(grams):
            return
        model = pack(gram_table(grams, counts.astype(np.int64)))
        tree = ctw.levels(grams, counts.astype(np.int64), DEPTH, 2)
        weights = ctw.weigh(tree)
        keys, zeros, ones, below = [], [], [], []
        for bit in range(8):
            level = tree[2]
            up = level.parent_keys(bit)
            nodes, at = np.unique(up, return_inverse=True)
            keys.append((nodes << np.uint64(3)) | np.uint64(bit))
            for out, values in ((zeros, level.zeros[bit]), (ones, level.ones[bit]), (below, weights[2][bit][0])):
                out.append(np.bincount(at, weights=values, minlength=len(nodes)))
        top = pack(pa.table({"node": np.concatenate(keys).astype(np.int64), "zeros": np.concatenate(zeros).astype(np.int64), "ones": np.concatenate(ones).astype(np.int64), "below": np.concatenate(below)}))
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([model], pa.binary()), pa.array([top], pa.binary())], names=["bucket", "blob", "top"])

    for batch in batches:
        for of, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if of != bucket:
                yield from done()
                parts, bucket, held = [], of, 0
            table = unpack(blob.as_py())
            grams, counts = gram_columns(table, np.uint32)
            own = counts > 0
            parts.append((grams[own], counts[own].astype(np.int64)))
            held += int(own.sum())
            if held > HELD_GRAMS:
                parts = [_merge(parts)]
                held = len(parts[0][0]) // 2
    yield from done()


def _unpacked_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("top"):
            yield from unpack(blob.as_py()).to_batches()


class Top:
    """Levels 0 and 1 of all trees: at most 255 and 65,280 nodes, whatever the corpus."""

    def __init__(self, rows: pa.Table):
        self.tree: dict[int, ctw.Level] = {}
        self.weights: dict[int, list] = {}
        node = rows.column("node").to_numpy().astype(np.uint64)
        bit = (node & np.uint64(7)).astype(np.int64)
        key = node >> np.uint64(3)
        values = [rows.column(c).to_numpy() for c in ("zeros", "ones", "below")]
        for d in (1, 0):
            level = ctw.Level(np.zeros(0, np.uint64), np.zeros(0, np.int64))
            weights, upper = [], []
            for b in range(8):
                own = bit == b
                keys, (zeros, ones, below) = key[own], (v[own] for v in values)
                order = np.argsort(keys)
                keys, zeros, ones, below = keys[order], zeros[order], ones[order], below[order]
                pe = ctw.log_pe(zeros, ones)
                pw = np.logaddexp(pe, below) - ctw.LN2
                weights.append((pw, np.exp(pe - ctw.LN2 - pw)))
                level.keys[b], level.zeros[b], level.ones[b] = keys, zeros, ones
                nodes, at = np.unique(keys & np.uint64(0xFF), return_inverse=True)
                upper.append((nodes, np.full(len(nodes), b), *(np.bincount(at, weights=v, minlength=len(nodes)) for v in (zeros, ones, pw))))
            self.tree[d], self.weights[d] = level, weights
            key, bit, zeros, ones, below = (np.concatenate(x) for x in zip(*upper, strict=True))
            values = [zeros.astype(np.int64), ones.astype(np.int64), below]


def _answer_grams(top: Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """log2 probabilities of the grams that each block asked for."""
        bucket = None
        grams = np.zeros(0, np.uint64)
        tree = weights = logs = None
        for batch in batches:
            for kind, block, of, blob in zip(*(batch.column(c) for c in ("kind", "block", "bucket", "blob")), strict=True):
                kind, block, of = kind.as_py(), block.as_py(), of.as_py()
                table = unpack(blob.as_py())
                asked, counts = gram_columns(table, np.int64 if kind == MODEL else np.uint32)
                if of != bucket or kind == MODEL:
                    bucket, tree, weights, logs = of, None, None, None
                    release()
                    grams, counts = (asked, counts) if kind == MODEL else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    tree = ctw.levels(grams, counts, DEPTH, 2)
                    weights = ctw.weigh(tree) | top.weights
                    tree |= top.tree
                    logs = ctw.log2_probability(grams, DEPTH, tree, weights)
                    if kind == MODEL:
                        continue
                at, seen = ctw.find(grams, asked)
                out = np.zeros(len(asked))
                out[seen] = logs[at[seen]]
                new = ~seen
                if new.any():
                    out[new] = ctw.log2_probability(asked[new], DEPTH, tree, weights)
                yield _row(GRAMS, block, of, gram_table(asked, out.astype(np.float32)))

    return run


class Lookup:
    """Values by gram: a table of slots, another for those whose slot was taken, a search in the sorted grams for the last few."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.logs = grams[order], logs[order]
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        own, values = self.grams, self.logs.astype(np.float64).view(np.uint64)
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            bits = max(4, int(2 * len(own) + 1).bit_length())
            # Key and value side by side: one place in memory for each look.
            slots = np.full((1 << bits, 2), np.uint64(0xFFFFFFFFFFFFFFFF))
            table = (np.uint64(factor), np.uint64(64 - bits), slots)
            at = self._slot(own, table)
            slots[at, 0], slots[at, 1] = own, values
            taken = slots[at, 0] != own
            own, values = own[taken], values[taken]
            self.tables.append(table)

    @staticmethod
    def _slot(grams: np.ndarray, table: tuple) -> np.ndarray:
        return ((grams * table[0]) >> table[1]).view(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        out = np.empty(len(grams))
        for start in range(0, len(grams), LOOKS):  # what is in hand stays in the processor's cache
            part = grams[start : start + LOOKS]
            found = self.tables[0][2].take(self._slot(part, self.tables[0]), axis=0)
            values = found[:, 1].copy().view(np.float64)
            miss = np.flatnonzero(found[:, 0] != part)
            if len(miss):
                left = part[miss]
                found = self.tables[1][2].take(self._slot(left, self.tables[1]), axis=0)
                values[miss] = found[:, 1].copy().view(np.float64)
                still = found[:, 0] != left
                if still.any():
                    at, seen = ctw.find(self.grams, left[still])
                    if not seen.all():
                        raise RuntimeError("a block asks for a gram that it did not state")
                    values[miss[still]] = self.logs[at]
            out[start : start + LOOKS] = values
        return out


def lookup_padded(lookup: Lookup, docs: list[bytes]) -> list[float]:
    """Sum of the values of each document's grams; each starts after a pad of its own."""
    pad = END * DEPTH
    keys = ctw.grams_of(np.frombuffer(b"".join(pad + doc for doc in docs), np.uint8), DEPTH)
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.cumsum(lengths + DEPTH) - lengths - DEPTH
    own = np.ones(len(keys), bool)
    for i in range(DEPTH):
        own[starts[1:] - DEPTH + i] = False
    return np.add.reduceat(lookup(keys[own]), np.cumsum(lengths) - lengths).tolist()


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_bytes", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])


def _score(end_log: float, end_known: bool):
    unknown = math.log10(0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, parts, lookup = None, {}, [], None
        for batch in batches:
            for kind, of, blob in zip(*(batch.column(c) for c in ("kind", "block", "blob")), strict=True):
                kind, of = kind.as_py(), of.as_py()
                if of != block:
                    block, words, parts, lookup = of, {}, [], None
                    release()
                table = unpack(blob.as_py())
                if kind == WORDS:
                    words.update(zip(table.column("word").to_pylist(), table.column("log").to_pylist(), strict=True))
                    continue
                if kind == GRAMS:
                    parts.append(gram_columns(table, np.float32))
                    continue
                if lookup is None:
                    lookup = Lookup(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    parts = []
                rows, docs = [], table.column("text").to_pylist()
                # All documents of the slice at once; the positions of the pads between them are left out of the sums.
                bits = lookup_padded(lookup, docs)
                for doc_id, held, doc, total in zip(table.column("doc_id").to_pylist(), table.column("held_out").to_pylist(), docs, bits, strict=True):
                    logs = list(map(words.__getitem__, doc.split()))
                    known = len(logs) - logs.count(unknown) + end_known
                    rows.append((doc_id, held, len(logs) + 1, known, len(doc), math.fsum(logs) + end_log, total * math.log10(2)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCORED, strict=True)], schema=_SCORED)

    return run


def score(docs: DataFrame) -> DataFrame:
    """Scores every row; training are those whose crc32 of the id modulo 5 is not 1.

    ``score`` is the model's log10 probability of the text, ``bits_per_byte`` its
    code length, ``base_score`` that of smoothed word frequencies.
    """
    spark = docs.sparkSession
    buckets, width = min(MOST_BUCKETS, BUCKETS_EACH * buckets_for(spark)), shuffle_partitions(spark)
    held = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    rows = spread(docs.select("doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"), F.spark_partition_id().alias("block"))
    asked = stored(rows.mapInArrow(_ask(buckets, rows.rdd.getNumPartitions(), width), _ROWS), "lm_blocks", "kind")
    words, grams, packed = (asked.where(F.col("kind") == k).select("kind", "block", "bucket", "blob") for k in (WORDS, GRAMS, DOCS))

    def dealt(df: DataFrame, by: str, *order: str) -> DataFrame:
        return df.repartition(width, by).sortWithinPartitions(by, *order)

    def model(df: DataFrame) -> DataFrame:
        return df.select(F.lit(MODEL).alias("kind"), F.lit(-1).alias("block"), "bucket", "blob")

    word_model = stored(dealt(words.select("bucket", "blob"), "bucket").mapInArrow(_sum_words, "bucket int, distinct long, total long, blob binary"), "lm_words")
    gram_model = stored(dealt(grams.select("bucket", "blob"), "bucket").mapInArrow(_sum_grams, "bucket int, blob binary, top binary"), "lm_grams")
    distinct, total = word_model.select(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    trained = docs.where(~held).count()
    n, v = total + trained, distinct + (trained > 0)
    nodes = gram_model.mapInArrow(_unpacked_top, "node long, zeros long, ones long, below double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
    top = Top(nodes.toArrow())  # contexts of one byte: 256 x 255 nodes at most
    word_answers = dealt(model(word_model).unionByName(words), "bucket", "kind").mapInArrow(_answer_words, _ROWS)
    gram_answers = dealt(model(gram_model).unionByName(grams), "bucket", "kind").mapInArrow(_answer_grams(top), _ROWS)
    met = dealt(word_answers.unionByName(gram_answers).unionByName(packed), "block", "kind")
    scored = met.mapInArrow(_score(math.log10(trained + 0.5), trained > 0), "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, logs double, score double")
    rest = math.log10(n + 0.5 * (v + 1))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(rest)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
