"""Vector functions as native columns."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import lone_and_shared
from .text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x))


#: Tokens whose digests a task keeps.
MOST_FOLDED = 500_000
#: Weights are multiples of one over this.
WHOLE = 9970


class _Folds:
    """Dimension and signed weight of a token, by its digest; digests are folded once a task."""

    def __init__(self, dims: int):
        self.dims, self.known = dims, {}

    def __call__(self, token: str) -> tuple[int, float]:
        found = self.known.get(token)
        if found is None:
            h = int.from_bytes(hashlib.sha1(token.encode()).digest(), "big")
            found = h % self.dims, (1.0 if h % 4 >= 2 else -1.0) * (1 + h % 997 / float(WHOLE))
            if len(self.known) >= MOST_FOLDED:
                self.known.clear()
            self.known[token] = found
        return found


def _sums(joined: str | None, fold: _Folds) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions that a text's tokens fall on, in order, and the sums of their weights."""
    counts = Counter(joined.split(" ")) if joined else {}
    folded = [fold(t) for t in counts]
    at = np.array([d for d, _ in folded], np.int64)
    w = np.bincount(at, np.array([e for _, e in folded]) * np.fromiter(counts.values(), float, len(counts)), fold.dims) if folded else np.zeros(fold.dims)
    on = np.unique(at)
    return on, w[on]


def _tokens_of(df: DataFrame, key: str, text: str) -> DataFrame:
    # Tokens have no spaces, so one string carries them.
    return df.select(key, F.array_join(tokens(F.col(text)), " ").alias("words"))


def _sparse(rows: DataFrame, key: str, dims: int, norm: bool) -> DataFrame:
    """Key, ``dim`` and weight by row; a text without a token has one row of weight 0 where ``norm`` is asked for, else none."""
    name = "weight" if norm else "w"

    def run(batches):
        fold = _Folds(dims)
        for batch in batches:
            at, dim, weights = [], [], []
            for i, joined in enumerate(batch.column("words").to_pylist()):
                on, w = _sums(joined, fold)
                if norm:
                    length = np.sqrt(w @ w)
                    on, w = (on, w / length if length > 0 else np.zeros(len(w))) if len(on) else (np.zeros(1, np.int64), np.zeros(1))
                at.append(np.full(len(on), i))
                dim.append(on)
                weights.append(w)
            each = [pa.array(np.concatenate(x) if x else np.zeros(0, t)).cast(k) for x, t, k in ((at, np.int64, pa.int64()), (dim, np.int64, pa.int64()), (weights, float, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(each[0]), each[1], each[2]], names=[key, "dim", name])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, dim bigint, {name} double")


def _summed(shared: DataFrame, key: str, dims: int) -> DataFrame:
    """Weights of keys that several rows have: these add up."""
    sums = _sparse(shared, key, dims, norm=False).groupBy(key, "dim").agg(F.sum("w").alias("w"))
    norms = sums.groupBy(F.col(key).alias("_key")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    made = sums.join(norms, F.col(key).eqNullSafe(F.col("_key"))).select(key, "dim", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(F.lit(0.0)).alias("weight"))
    none = shared.groupBy(key).agg(F.max(F.coalesce("words", F.lit(""))).alias("most")).where("most = ''")
    return made.unionByName(none.select(key, F.lit(0).cast("long").alias("dim"), F.lit(0.0).alias("weight")))


def hash_embedding(df: DataFrame, key: str, text: str, dims: int = 384) -> DataFrame:
    """Signed hashed token weights by dimension: ``key``, ``dim``, ``weight``, of unit length.

    A text's tokens are counted and summed where it is read. A text without a token
    is the zero vector: one row of ``dim`` 0 and weight 0. Rows that share a key
    add up; only these are shuffled.
    """
    dims = max(16, dims)
    lone, shared = lone_and_shared(_tokens_of(df, key, text), key)
    out = _sparse(lone, key, dims, norm=True)
    return out if shared is None else out.unionByName(_summed(shared, key, dims))


def hash_vectors(df: DataFrame, key: str, text: str, dims: int = 384, digits: int | None = None) -> DataFrame:
    """``key`` and ``vec``: ``hash_embedding`` as one array for each key, rounded to ``digits``."""
    dims = max(16, dims)
    lone, shared = lone_and_shared(_tokens_of(df, key, text), key)

    def run(batches):
        fold = _Folds(dims)
        for batch in batches:
            out = np.zeros((batch.num_rows, dims))
            for row, joined in zip(out, batch.column("words").to_pylist(), strict=True):
                on, w = _sums(joined, fold)
                length = np.sqrt(w @ w)
                if length > 0:
                    row[on] = w / length
            out = out if digits is None else np.round(out, digits)
            offsets = pa.array(np.arange(batch.num_rows + 1) * dims, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=[key, "vec"])

    made = lone.mapInArrow(run, f"{key} {lone.schema[key].dataType.simpleString()}, vec array<double>")
    if shared is None:
        return made
    summed = dense(_summed(shared, key, dims), key, dims)
    return made.unionByName(summed if digits is None else summed.select(key, F.transform("vec", lambda x: F.round(x, digits)).alias("vec")))


def dense(weights: DataFrame, key: str, dims: int) -> DataFrame:
    """``key`` and ``vec``: the rows of ``hash_embedding`` as one array for each key."""
    own = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("dim").cast("int"), F.col("weight")))).alias("_m"))
    return own.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at("_m", d), F.lit(0.0))).alias("vec"))


def text_sums(df: DataFrame, key: str, text: str, dims: int = 384) -> DataFrame:
    """``hash_embedding`` of each distinct text, but for its length: key, and the ``places`` and ``parts`` of what isn't zero.

    A text's key is the least of those that have it; texts of one key still have to
    be added up (``added_sums``). Parts are whole numbers, a token's least weight is
    ``WHOLE``. Texts without a token are left out. Texts meet by their digests, with
    what was summed where they were read.
    """
    own = df.where(F.col(key).isNotNull()).select(key, F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("digest"), F.array_join(tokens(F.col(text)), " ").alias("words"))
    first = _whole_sums(own, dims).groupBy("digest").agg(F.min(F.struct(key, "places", "parts")).alias("x"))
    return first.select(f"x.{key}", "x.places", "x.parts")


def _whole_sums(rows: DataFrame, dims: int) -> DataFrame:
    """Rows that have ``words``, with ``places`` and ``parts`` instead."""
    dims, others = max(16, dims), [c for c in rows.columns if c != "words"]

    def run(batches):
        fold = _Folds(dims)
        for batch in batches:
            sums = [_sums(joined, fold) for joined in batch.column("words").to_pylist()]
            offsets = pa.array(np.cumsum([0, *(len(on) for on, _ in sums)]), pa.int32())
            places = np.concatenate([np.zeros(0, np.int16), *(on.astype(np.int16) for on, _ in sums)])
            parts = np.rint(np.concatenate([np.zeros(0), *(w for _, w in sums)]) * WHOLE).astype(np.int64)
            made = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (places, parts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], names=[*others, "places", "parts"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.where("words <> ''").mapInArrow(run, f"{schema}, places array<smallint>, parts array<bigint>")


def hash_sums(df: DataFrame, key: str, text: str, dims: int = 384) -> DataFrame:
    """``hash_embedding``, but for its length: key, and the ``places`` and ``parts`` of what isn't zero, in whole numbers (see ``text_sums``).

    Made where a text is read; only rows that share a key are shuffled. Keys without a token are left out.
    """
    lone, shared = lone_and_shared(_tokens_of(df, key, text), key)
    out = _whole_sums(lone, dims)
    out = out if shared is None else out.unionByName(_added(_whole_sums(shared, dims), key))
    return out.where(F.exists("parts", lambda x: x != 0))


def _added(shared: DataFrame, key: str) -> DataFrame:
    each = shared.select(key, F.explode(F.arrays_zip("places", "parts")).alias("x")).groupBy(key, F.col("x.places").alias("place")).agg(F.sum("x.parts").alias("part"))
    listed = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("x"))
    return listed.select(key, F.col("x.place").alias("places"), F.col("x.part").alias("parts"))


def added_sums(sums: DataFrame, key: str) -> DataFrame:
    """Stored ``text_sums`` with one row a key; those that come to nothing are left out."""
    lone, shared = lone_and_shared(sums, key)
    out = lone if shared is None else lone.unionByName(_added(shared, key))
    return out.where(F.exists("parts", lambda x: x != 0))
