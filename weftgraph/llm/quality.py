"""Quality rules and a hashed n-gram quality classifier.

Features are hashed word unigrams and bigrams and hashed character n-grams
(bytes), each family as relative frequencies. A logistic regression is trained
on the driver on a bounded sample of labelled rows and calibrated by Platt's
method on a fold of it that training doesn't see. The sample's bounds are
parameters: ``SAMPLE`` labelled ids, those of the smallest hashes, one text an
id, and of these, in the order of the hashes, whole texts of ``SAMPLE_BYTES``
bytes together. Only texts that were chosen by length reach the driver.
Scoring runs in Arrow batches over all rows, whole texts, against fixed
thresholds.

Null text has no words, fails the base rules, and is not kept. Null labels and
null ids don't count; a row labelled twice has its lower label; of rows that
share a labelled id one text (by hash) trains, and each is scored on its own.
Repeated rows are scored alike. An empty table gives an empty result. Other
columns, whatever their names, are not read; ``keep_good`` returns them as they
are. Without labels of both kinds the classifier gives the share of good labels
(1 without any) to all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spread, texts

#: Labelled rows that the classifier is fitted on, at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 4_000, 8 << 20
BITS = 16
#: Kept from this calibrated probability of good quality on.
THRESHOLD = 0.5
#: The base rules: fewest words, and most words in repeated three-word windows, per cent.
LEAST_WORDS, MOST_REPEATED = 50, 50
_FAMILIES = ("char3", "char5", "word1", "word2")
_SCALE = 30.0
_BLOCK = 1 << 20  # entries of the feature matrix taken at once
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def base_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    word_chars = len(text) - (len(data) - len(data.translate(None, _SPACE)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    marked, upto = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            marked += i + 3 - max(i, upto)
            upto = i + 3
    return marked


def _hashed_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Slot of the n-gram that starts at each byte."""
    h = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for i in range(n):
        h *= np.uint32(16_777_619)
        h ^= data[i : i + len(h)]
    h *= np.uint32(2_654_435_761)
    return h >> np.uint32(32 - BITS)


def features(text: str) -> list[np.ndarray]:
    """Slots of all n-grams of a text, by family."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    words = np.fromiter(map(crc32, raw.split()), np.uint32)
    pairs = words[:-1] * np.uint32(0x9E3779B1) ^ words[1:]
    slots = [(w * np.uint32(2_654_435_761)) >> np.uint32(32 - BITS) for w in (words, pairs)]
    return [_hashed_grams(data, 3), _hashed_grams(data, 5), *slots]


@dataclass
class Classifier:
    weights: np.ndarray  # family x slot
    bias: float
    slope: float  # of the calibration
    offset: float

    def margins(self, many: list[str]) -> np.ndarray:
        out = np.full(len(many), self.bias)
        for i, text in enumerate(many):
            for family, slots in zip(self.weights, features(text), strict=True):
                if len(slots):
                    out[i] += _SCALE * float(family[slots].mean(dtype=np.float64))
        return out

    def probabilities(self, many: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(many) + self.offset, -500, 500)))


def _sparse(many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the feature matrix."""
    rows, cols, values = [], [], []
    for i, text in enumerate(many):
        for f, slots in enumerate(features(text)):
            if len(slots):
                own, n = np.unique(slots, return_counts=True)
                cols.append((own + f * (1 << BITS)).astype(np.int32))
                values.append((_SCALE * n / len(slots)).astype(np.float32))
                rows.append(np.full(len(own), i, np.int32))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def train(many: list[str], labels: np.ndarray, steps: int = 60, ridge: float = 1e-4) -> Classifier:
    """Fits by full-batch Adam on three quarters of the rows, calibrates on the fourth."""
    size = len(_FAMILIES) << BITS
    share = float(labels.mean()) if len(labels) else 1.0
    held = np.arange(len(labels)) % 4 == 3
    y = labels[~held].astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Classifier(np.zeros((len(_FAMILIES), 1 << BITS), np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    rows, cols, values = _sparse([t for t, h in zip(many, held, strict=True) if not h])
    # Both kinds weigh the same in training; calibration restores the true shares.
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    # Products are taken in blocks: their 8-byte copies would outweigh the matrix.
    blocks = [slice(i, i + _BLOCK) for i in range(0, len(rows), _BLOCK)]
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.full(len(y), b)
        for at in blocks:
            z += np.bincount(rows[at], weights=values[at] * w[cols[at]], minlength=len(y))
        err = each * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = ridge * w
        for at in blocks:
            grad += np.bincount(cols[at], weights=values[at] * err[rows[at]], minlength=size)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * err.sum(), 0.99 * vb + 0.01 * err.sum() ** 2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    out = Classifier(w.astype(np.float32).reshape(len(_FAMILIES), -1), float(b), 1.0, 0.0)
    rest = [t for t, h in zip(many, held, strict=True) if h]
    if rest:
        out.slope, out.offset = platt(out.margins(rest), labels[held])
    return out


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid that fits labels to margins, with Platt's softened targets."""
    good, bad = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -500, 500)))
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        q = p * (1 - p)
        hess = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, c = a - step[0], c - step[1]
        if float(np.abs(step).max()) < 1e-9:
            break
    return max(float(a), 1e-3), float(c)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Classifier:
    """Trains on at most ``rows`` labelled documents, of ``most_bytes`` bytes in all, of the smallest id hashes."""
    spark = docs.sparkSession
    own = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    drawn = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded: broadcast
    text = F.coalesce("text", F.lit("")).alias("text")
    keyed = docs.select("doc_id", text).select("doc_id", "text", F.xxhash64("text").alias("tie"))
    # First one (hash, length) an id, then only the texts that fit.
    least = F.min(F.struct("tie", F.octet_length("text").alias("n")))
    sizes = keyed.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(least.alias("s"), F.first("quality").alias("quality"))
    chosen, held = [], 0
    for r in sizes.select("doc_id", "s.tie", "s.n", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if held + r.n <= most_bytes:
            held += r.n
            chosen.append((r.doc_id, r.tie, r.quality))
    if not chosen:
        return train([], np.zeros(0, np.int64))
    wanted = spark.createDataFrame(chosen, "doc_id long, tie long, quality int")
    table = keyed.join(F.broadcast(wanted), ["doc_id", "tie"]).select("doc_id", "quality", "text").dropDuplicates(["doc_id"]).toArrow()
    table = table.take(pa.array(np.argsort(table.column("doc_id").to_numpy(), kind="stable")))
    # Folds must not follow the ids' order in time.
    table = table.take(pa.array(np.random.Generator(np.random.PCG64(11)).permutation(table.num_rows)))
    return train(table.column("text").to_pylist(), (table.column("quality").to_numpy() > 0).astype(np.int64))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base rules, calibrated probability and verdict of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                many = texts(part.column("text"))
                columns = list(zip(*map(base_statistics, many), strict=True))
                n_words, repeats = np.asarray(columns[0]), np.asarray(columns[4])
                failed = (n_words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n_words)
                p = model.value.probabilities(many)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed), pa.array(~failed & (p >= THRESHOLD)), pa.array(p)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"],
                )

    rows = spread(docs.select("doc_id", "text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, in all their columns; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                many = texts(part.column("text"))
                stats = [base_statistics(t) for t in many]
                good = [s[0] >= LEAST_WORDS and 100 * s[4] <= MOST_REPEATED * s[0] for s in stats]
                p = model.value.probabilities(many)
                yield part.filter(pa.array([g and q >= THRESHOLD for g, q in zip(good, p, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
