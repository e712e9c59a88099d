"""A stored vector index, and top-k and threshold joins of vectors in blocks.

The index is a folder of two tables. ``rows`` has a partition for each cell of a
coarse quantiser: key, vector, product code of the residual, and the distance to
the cell's centre. ``model`` has centres, code books, and size and radius of each
cell. The model is fitted on at most ``SAMPLE`` rows (those of the least
seeded hash), every row is indexed.

``search`` reads the codes of the ``probes`` nearest cells of each query (other
cells are pruned at the scan), keeps the best by code, and ranks these by their
vectors. With ``exact`` that gives a bound for each query: all cells that may hold
something nearer (centre minus radius) are then read and compared whole.

Cosine is Euclidean distance of unit vectors. A zero vector gets an axis of its
own, so its cosine with any other is 0. Null vectors and those of other
dimensions are not indexed and find nothing. Of equal scores the smaller key
comes first.

Rows and queries meet in blocks: a cell of many rows or asked by many queries is
dealt over several tasks, so a hot cell makes no large one, and a task's result
is its own best ``top_k`` for each query, merged by query afterwards. All pairs of
a table are found in packs of rows that meet without a shuffle (``sparse_pairs``).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, euclidean
from ..storage import numbered, stored
from .search import check_index

#: Rows that the model is fitted on, at most.
SAMPLE = 20_000
#: Cells, at most; fewer in small tables.
MOST_CELLS = 4096
#: Dimensions that one byte of a code stands for, and the words of a code book.
SUB, WORDS = 4, 256
#: Rows and queries of a block.
ROWS_EACH, QUERIES_EACH = 20_000, 1_000
#: Pairs: blocks of a table, rows of a block at most, rows of a tile, and axes of the projections, of all and of the first look.
PAIR_BLOCKS, PAIR_ROWS, TILE, AXES, FIRST_AXES = 8, 200_000, 512, 96, 64
#: Rows of a pack, packs that a task keeps unpacked, partitions of the packs while they have few, and rows that the axes are made of.
PACK_ROWS, SIDES, PAIR_SPLITS, PAIR_SAMPLE = 8192, 12, 16, 20_000
#: Candidates by code for each wanted neighbour.
RERANK = 8
#: Up to so many candidates are broadcast to pick out their vectors; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def placed(vectors: np.ndarray, similarity: str, query: bool = False) -> np.ndarray:
    """Vectors in the space where near is Euclidean: for cosine unit vectors, with an axis for zero rows and one for zero queries."""
    if similarity == "euclidean":
        return vectors
    norms = np.linalg.norm(vectors, axis=1)
    out = np.zeros((len(vectors), vectors.shape[1] + 2))
    some = norms > 0
    out[some, :-2] = vectors[some] / norms[some, None]
    out[~some, -1 if query else -2] = 1
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def scores(queries: np.ndarray, rows: np.ndarray, similarity: str) -> np.ndarray:
    """What ``functions.vectors`` would give for each pair of placed vectors."""
    return queries @ rows.T if similarity == "cosine" else 1 / (1 + distances(queries, rows))


def centres_of(rows: np.ndarray, k: int, seed: int, turns: int = 12) -> np.ndarray:
    """k means of a sample; empty ones start again at the rows that lie farthest off."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(rows)))
    centres = rows[rng.choice(len(rows), k, replace=False)] if len(rows) else np.zeros((1, rows.shape[1]))
    for _ in range(turns if len(rows) else 0):
        d = distances(rows, centres)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=rows[:, j], minlength=k) for j in range(rows.shape[1])], axis=1)
        centres = sums / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = rows[np.argsort(-d.min(axis=1))[: len(empty)]]
    return centres


@dataclass(frozen=True)
class Model:
    similarity: str
    dims: int
    centres: np.ndarray
    #: One book for each group of SUB dimensions (the last may be narrower).
    books: list[np.ndarray]

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(rows, self.centres)
        own = d.argmin(axis=1)
        return own, d[np.arange(len(rows)), own]

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([distances(residuals[:, SUB * j : SUB * (j + 1)], book).argmin(axis=1).astype(np.uint8) for j, book in enumerate(self.books)], axis=1)

    def by_code(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query's residual to the rows' codes."""
        out = np.zeros(len(codes))
        for j, book in enumerate(self.books):
            out += ((book - residual[SUB * j : SUB * (j + 1)]) ** 2).sum(axis=1)[codes[:, j]]
        return out


def fitted(sample: np.ndarray, similarity: str, dims: int, cells: int, seed: int = 1) -> Model:
    rows = placed(sample, similarity)
    centres = centres_of(rows, cells, seed)
    rest = rows - centres[distances(rows, centres).argmin(axis=1)] if len(rows) else rows
    books = [centres_of(rest[:, at : at + SUB], min(WORDS, max(1, len(rest))), seed + 1 + at) for at in range(0, rows.shape[1], SUB)]
    return Model(similarity, dims, centres, books)


@dataclass(frozen=True)
class VectorIndex:
    path: str
    name: str
    model: Model
    #: Size and radius of each cell.
    sizes: np.ndarray
    radii: np.ndarray
    #: Columns of the rows.
    schema: str

    def rows(self, spark: SparkSession, cells: list[int] | None = None) -> DataFrame:
        """The indexed rows, of some cells only: those files alone are read."""
        rows = spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))


def _usable(df: DataFrame, key: str, vector: str, dims: int, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull())).select(F.col(key).alias(name), F.col(vector).cast(_kind(df, vector)).alias("vec"))


def _kind(df: DataFrame, vector: str) -> str:
    """Vectors of floats stay so, others are doubles."""
    return "array<float>" if df.schema[vector].dataType.elementType.simpleString() == "float" else "array<double>"


def build(vectors: DataFrame, key: str, vector: str, path: str, dims: int, similarity: str = "cosine", name: str = "chunk_embedding_index", cells: int | None = None, seed: int = 1) -> VectorIndex:
    """Writes the index of a table with one vector a key."""
    spark = vectors.sparkSession
    check_index(dims, similarity, name)
    rows = _usable(vectors, key, vector, dims, "key")
    n = rows.count()
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(SAMPLE).select("vec").toArrow()
    sample = matrix(picked.column("vec"), dims) if picked.num_rows else np.zeros((0, dims))
    model = fitted(sample, similarity, dims, cells or max(1, min(MOST_CELLS, int(n**0.5), len(sample) // 8)), seed)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for batch in batches:
            at = placed(matrix(batch.column("vec"), dims), similarity)
            cell, far = own.cells(at)
            codes = own.codes(at - own.centres[cell]) if len(at) else np.zeros((0, len(own.books)), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far, pa.float64()), pa.array(cell, pa.int32())], names=["key", "vec", "code", "far", "cell"])

    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, vec {_kind(vectors, vector)}, code binary, far double, cell int"
    made = rows.mapInArrow(run, schema)
    made.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    if n:
        stats = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).toArrow()  # a row for a cell
    else:
        stats = pa.table({"cell": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "radius": pa.array([], pa.float64())})
    sizes, radii = np.zeros(len(model.centres), np.int64), np.zeros(len(model.centres))
    sizes[stats.column("cell").to_numpy()] = stats.column("n").to_numpy()
    radii[stats.column("cell").to_numpy()] = stats.column("radius").to_numpy()
    index = VectorIndex(path, name, model, sizes, radii, schema)
    spark.createDataFrame([(bytearray(pickle.dumps(index)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return index


def load(spark: SparkSession, path: str) -> VectorIndex:
    return pickle.loads(bytes(spark.read.parquet(f"{path}/model").first().model))


def _parts(sizes: np.ndarray, each: int) -> np.ndarray:
    return np.maximum(1, -(-sizes // each))


def _met(rows: DataFrame, asked: DataFrame, sizes: np.ndarray, work: Callable, schema: str) -> DataFrame:
    """Rows (cell, ...) and queries (query, cell, ...) meet by cell, in blocks of bounded size, for ``work``(rows, queries)."""
    spark = rows.sparkSession
    many = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row for a cell
    cuts = [(int(c), int(_parts(sizes[c : c + 1], ROWS_EACH)[0]), -(-n // QUERIES_EACH)) for c, n in many.items()]
    dealt = F.broadcast(spark.createDataFrame(cuts, "cell int, parts int, blocks int"))
    left = rows.join(dealt, "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("parts", "blocks")
    right = asked.join(dealt, "cell").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "blocks")
    by = ["cell", "part", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(work, schema)


def best_of(found: DataFrame, top_k: int, *order) -> DataFrame:
    """The first ``top_k`` of each query, numbered from 1 as ``place``."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return found.withColumn("place", place).where(F.col("place") <= top_k)


def _top(score: np.ndarray, keys: list, k: int) -> list[int]:
    """Places of the k highest scores, ties by key."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return sorted(at.tolist(), key=lambda i: (-score[i], keys[i]))[:k]


def _compared(similarity: str, dims: int, top_k: int, query_type: pa.DataType, key_type: pa.DataType):
    """The best rows of a block for each of its queries, by their vectors; only those that reach the query's bound."""

    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and asked.num_rows:
            keys, own = rows.column("key").to_pylist(), placed(matrix(rows.column("vec"), dims), similarity)
            queries, wanted = asked.column("query").to_pylist(), placed(matrix(asked.column("vec"), dims), similarity, query=True)
            least = asked.column("least").to_pylist()
            for at in range(0, len(queries), 64):
                for q, bound, s in zip(queries[at : at + 64], least[at : at + 64], scores(wanted[at : at + 64], own, similarity), strict=True):
                    for i in _top(s, keys, top_k):
                        if bound is None or s[i] >= bound:
                            out[0].append(q)
                            out[1].append(keys[i])
                            out[2].append(float(s[i]))
        return pa.table([pa.array(out[0], query_type), pa.array(out[1], key_type), pa.array(out[2], pa.float64())], names=["query", "key", "score"])

    return work


def _types(query: DataFrame, query_key: str, rows: DataFrame, key: str) -> tuple[str, pa.DataType, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    q, k = query.schema[query_key].dataType, rows.schema[key].dataType
    return f"query {q.simpleString()}, key {k.simpleString()}, score double", to_arrow_type(q), to_arrow_type(k)


def nearest_each(queries: DataFrame, query_key: str, query_vector: str, vectors: DataFrame, key: str, vector: str, dims: int, top_k: int = 8, similarity: str = "cosine") -> DataFrame:
    """The exact nearest rows of each query, without an index: ``query``, ``key``, ``score``, ``place``. All rows are compared, in blocks."""
    schema, query_type, key_type = _types(queries, query_key, vectors, key)
    rows = _usable(vectors, key, vector, dims, "key").withColumn("cell", F.lit(0))
    asked = _usable(queries, query_key, query_vector, dims, "query").withColumns({"cell": F.lit(0), "least": F.lit(None).cast("double")})
    found = _met(rows, asked, np.array([vectors.count()]), _compared(similarity, dims, top_k, query_type, key_type), schema)
    return best_of(found, top_k, F.desc("score"), "key")


def _reached(held, dims: int, probes: int | None):
    """The cells that a query asks: its nearest ones, or with a bound all that may reach it."""

    def run(batches):
        index: VectorIndex = held.value
        model = index.model
        full = np.flatnonzero(index.sizes > 0)
        for batch in batches:
            d = distances(placed(matrix(batch.column("vec"), dims), model.similarity, query=True), model.centres[full])
            if probes is not None:
                pick = np.zeros(d.shape, bool)
                near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                np.put_along_axis(pick, near, True, axis=1)
            else:
                least = np.array(batch.column("least").to_pylist(), dtype=np.float64)  # null is NaN
                most = np.sqrt(np.maximum(2 - 2 * least, 0)) if model.similarity == "cosine" else 1 / least - 1
                pick = ~(d - index.radii[full][None, :] > (most + 1e-6)[:, None])
            row, cell = np.nonzero(pick)
            took = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(full[cell], pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def _by_code(held, dims: int, keep: int, query_type: pa.DataType, key_type: pa.DataType):
    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if rows.num_rows and asked.num_rows:
            model: Model = held.value.model
            cell = asked.column("cell")[0].as_py()
            keys = rows.column("key").to_pylist()
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(keys), -1)
            rest = placed(matrix(asked.column("vec"), dims), model.similarity, query=True) - model.centres[cell]
            for q, r in zip(asked.column("query").to_pylist(), rest, strict=True):
                about = -model.by_code(r, codes)
                for i in _top(about, keys, keep):
                    out[0].append(q)
                    out[1].append(keys[i])
                    out[2].append(float(about[i]))
                    out[3].append(cell)
        return pa.table([pa.array(out[0], query_type), pa.array(out[1], key_type), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int32())], names=["query", "key", "about", "cell"])

    return work


def search(index: VectorIndex, queries: DataFrame, query_key: str, query_vector: str, top_k: int = 10, probes: int = 8, rerank: int = RERANK, exact: bool = False) -> DataFrame:
    """The nearest indexed rows of each query: ``query``, ``key``, ``score``, ``place``.

    Without ``exact`` neighbours outside the probed cells, or badly ranked by code, are missed.
    """
    spark, model = queries.sparkSession, index.model
    every = index.rows(spark)
    schema, query_type, key_type = _types(queries, query_key, every, "key")
    held = spark.sparkContext.broadcast(index)  # the model, at most MOST_CELLS centres
    q = queries.schema[query_key].dataType.simpleString()
    wanted = _usable(queries, query_key, query_vector, model.dims, "query")
    asked = stored(wanted.mapInArrow(_reached(held, model.dims, probes), f"query {q}, vec {_kind(queries, query_vector)}, cell int"), "asked")
    cells = sorted(r.cell for r in asked.select("cell").distinct().collect())  # a row for a cell
    codes = index.rows(spark, cells).select("cell", "key", "code")
    near = _met(codes, asked, index.sizes, _by_code(held, model.dims, top_k * rerank, query_type, key_type), f"query {q}, key {every.schema['key'].dataType.simpleString()}, about double, cell int")
    near = stored(best_of(near, top_k * rerank, F.desc("about"), "key").select("query", "key", "cell"), "candidates")
    few = near.count() <= BROADCAST_ROWS
    met = index.rows(spark, cells).select("cell", "key", F.col("vec").alias("own")).join(F.broadcast(near) if few else near, ["cell", "key"])
    score = cosine(F.col("own"), F.col("vec")) if model.similarity == "cosine" else 1 / (1 + euclidean(F.col("own"), F.col("vec")))
    found = best_of(met.join(wanted, "query").select("query", "key", score.alias("score")), top_k, F.desc("score"), "key")
    if not exact:
        return found
    bound = found.where(F.col("place") == top_k).select("query", (F.col("score") - 1e-9).alias("least"))
    bounded = wanted.join(bound, "query", "left")
    asked = stored(bounded.mapInArrow(_reached(held, model.dims, None), f"query {q}, vec {_kind(queries, query_vector)}, least double, cell int"), "asked")
    cells = sorted(r.cell for r in asked.select("cell").distinct().collect())
    whole = _met(index.rows(spark, cells).select("cell", "key", "vec"), asked, index.sizes, _compared(model.similarity, model.dims, top_k, query_type, key_type), schema)
    return best_of(whole, top_k, F.desc("score"), "key")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true neighbours that were found."""
    n = truth.count()
    return truth.select("query", "key").join(found.select("query", "key"), ["query", "key"], "left_semi").count() / n if n else 1.0


def _homes(held, dims: int, farthest: float):
    """Each row in its own cell (``home``), and in each later cell that may hold a row as near as ``farthest``."""

    def run(batches):
        centres, radii = held.value
        between = distances(centres, centres)
        for batch in batches:
            d = distances(placed(matrix(batch.column("vec"), dims), "cosine"), centres)
            own = d.argmin(axis=1)
            at = d[np.arange(len(d)), own][:, None]
            # No row of a cell j is nearer than the plane halfway between both centres, nor than its ball.
            plane = (d * d - at * at) / np.maximum(2 * between[own], 1e-12)
            pick = (plane <= farthest + 1e-6) & (np.arange(len(centres))[None, :] > own[:, None])
            if radii is not None:
                pick &= d <= radii[None, :] + farthest + 1e-6
            pick[np.arange(len(d)), own] = True
            row, cell = np.nonzero(pick)
            took = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cell, pa.int32()), pa.array(cell == own[row]), pa.array(d[row, cell], pa.float64())], names=[*batch.schema.names, "cell", "home", "far"])

    return run


def cell_plan(vectors: DataFrame, key: str, vector: str, dims: int, least: float, pivots: int | None = None, seed: int = 1) -> DataFrame:
    """Rows by cell, at home or guests: (query, vec, cell, home, far); all pairs of ``least`` or more meet in a cell."""
    spark = vectors.sparkSession
    rows = _usable(vectors, key, vector, dims, "query")
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "query"), "query").limit(SAMPLE).select("vec").toArrow()
    sample = placed(matrix(picked.column("vec"), dims), "cosine") if picked.num_rows else np.zeros((0, dims + 2))
    wanted = pivots or max(1, min(MOST_CELLS, int(len(sample) ** 0.5 / 3)))
    rng = np.random.default_rng(seed)
    centres = np.unique(sample[rng.permutation(len(sample))[:wanted]], axis=0) if len(sample) else np.zeros((1, dims + 2))
    farthest = float(np.sqrt(max(0.0, 2 - 2 * least)))
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"query {kind}, vec {_kind(vectors, vector)}, cell int, home boolean, far double"
    alone = rows.mapInArrow(_homes(spark.sparkContext.broadcast((centres, None)), dims, -1.0), schema)
    radii = np.zeros(len(centres))
    for r in alone.where("home").groupBy("cell").agg(F.max("far").alias("radius")).collect():  # a row for a cell
        radii[r.cell] = r.radius
    return rows.mapInArrow(_homes(spark.sparkContext.broadcast((centres, radii)), dims, farthest), schema)


@dataclass(frozen=True)
class _Axes:
    """The axes along which a sample of unit vectors is longest."""

    axes: np.ndarray

    def placed(self, units: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Projections on all axes and on the ``first``, with the length of what is left out as one more axis: their dot products are no less than the vectors' own."""
        at = units @ self.axes
        squares = np.cumsum(at * at, axis=1)
        rest = lambda k: np.sqrt(np.maximum(1 - squares[:, k - 1 : k], 0))
        every, first = self.axes.shape[1], min(first, self.axes.shape[1])
        return np.hstack([at, rest(every)]).astype(np.float32), np.hstack([at[:, :first], rest(first)]).astype(np.float32)


def _sparse(dims: int):
    """Vectors as the places and values of what isn't zero."""

    def run(batches):
        for batch in batches:
            values = matrix(batch.column("vec"), dims)
            row, place = np.nonzero(values)
            offsets = pa.array(np.searchsorted(row, np.arange(len(values) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place.astype(np.int16), values[row, place])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *lists], names=["key", "places", "parts"])

    return run


def _packs(most: int):
    """Up to so many rows (key, places, parts) as one value, and how many they are."""

    def packed(rows: pa.Table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(rows.combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([len(rows)], pa.int32())], names=["rows", "n"])

    def run(batches):
        some = None
        for batch in batches:
            got = pa.Table.from_batches([batch])
            some = got if some is None else pa.concat_tables([some, got])
            while len(some) >= most:
                yield packed(some.slice(0, most))
                some = some.slice(most)
        if some is not None and len(some):
            yield packed(some)

    return run


class _Side:
    """A pack's rows in tiles of near ones, each in a box of the projections."""

    def __init__(self, packed: pa.Buffer, dims: int, held: _Axes, tile: int, first: int):
        rows = pa.ipc.open_stream(packed).read_all().combine_chunks()
        self.dims, self.keys = dims, rows.column("key").combine_chunks()
        lists = rows.column("places").combine_chunks()
        self.sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.places = lists.flatten().to_numpy()
        parts = rows.column("parts").combine_chunks().flatten().to_numpy().astype(np.float64)
        norms = np.sqrt(np.bincount(np.repeat(np.arange(len(rows)), self.sizes), parts * parts, len(rows)))
        self.parts = parts / np.repeat(np.where(norms > 0, norms, 1), self.sizes)
        placed = [held.placed(self.dense(np.arange(a, min(a + 2048, len(rows)))), first) for a in range(0, len(rows), 2048)]
        at, near = (np.vstack(x) for x in zip(*placed, strict=True))
        self.order = np.concatenate(list(_split(at, np.arange(len(rows)), tile)))
        self.at, self.near = at[self.order], near[self.order]
        self.tiles = [(a, min(a + tile, len(rows))) for a in range(0, len(rows), tile)]
        self.low, self.high = (np.stack([f(self.at[a:b], axis=0) for a, b in self.tiles]) for f in (np.min, np.max))

    def dense(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.sizes[rows]
        of = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(of)) + np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)
        out = np.zeros((len(rows), self.dims))
        out[of, self.places[at]] = self.parts[at]
        return out


def _split(at: np.ndarray, rows: np.ndarray, tile: int):
    """Rows in tiles: halves along the axis on which they vary most, again and again."""
    if len(rows) <= tile:
        yield rows
        return
    axis = at[rows, :8].var(axis=0).argmax()
    rows = rows[np.argsort(at[rows, axis], kind="stable")]
    half = -(-len(rows) // (2 * tile)) * tile
    yield from _split(at, rows[:half], tile)
    yield from _split(at, rows[half:], tile)


def _true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a matrix with hardly anything true is true."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (eights[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, mask.shape[1])


def _met_sides(one: _Side, other: _Side, least: float):
    """Pairs of two packs (or within one) and their cosines: by boxes, then by few axes, by all of them, by the vectors."""
    farthest = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-3
    gaps = np.maximum(0, np.maximum(one.low[:, None] - other.high[None], other.low[None] - one.high[:, None]))
    for x, y in zip(*np.nonzero((gaps * gaps).sum(axis=2) <= farthest * farthest), strict=True):
        if one is other and y < x:
            continue
        (a, b), (c, d) = one.tiles[x], other.tiles[y]
        i, j = _true(one.near[a:b] @ other.near[c:d].T >= least - 1e-4)
        if one is other and x == y:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 20_000):
            p, q = a + i[at : at + 20_000], c + j[at : at + 20_000]
            ok = np.einsum("ij,ij->i", one.at[p], other.at[q]) >= least - 1e-4
            p, q = one.order[p[ok]], other.order[q[ok]]
            (some, of_p), (others, of_q) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
            score = np.einsum("ij,ij->i", one.dense(some)[of_p], other.dense(others)[of_q])
            ok = score >= least - 1e-12
            if ok.any():
                yield p[ok], q[ok], score[ok]


def _pack_pairs(held, dims: int, least: float, key_type: pa.DataType, tile: int, first: int, kept: int):
    def run(batches):
        # A pack meets all those of a partition in turn, again and again: what came first stays, the last place changes.
        one, number, sides = None, None, {}
        opened = lambda packed: _Side(packed.as_buffer(), dims, held.value, tile, first)
        for batch in batches:
            for n, (pack, with_pack) in enumerate(zip(batch.column("pack").to_pylist(), batch.column("with_pack").to_pylist(), strict=True)):
                if pack != number:
                    one, number = sides.get(pack) or opened(batch.column("rows")[n]), pack
                other = one if with_pack == pack else sides.get(with_pack)
                if other is None:
                    if len(sides) >= kept:
                        sides.popitem()
                    other = sides[with_pack] = opened(batch.column("with_rows")[n])
                for p, q, score in _met_sides(one, other, least):
                    left, right = one.keys.take(pa.array(p)).cast(key_type), other.keys.take(pa.array(q)).cast(key_type)
                    swap, same = pc.greater(left, right), pc.not_equal(left, right)
                    yield pa.RecordBatch.from_arrays([pc.if_else(swap, right, left), pc.if_else(swap, left, right), pa.array(score)], names=["src", "dst", "score"]).filter(same)

    return run


def similar_pairs(vectors: DataFrame, key: str, vector: str, dims: int, least: float = 0.95, pivots: int | None = None) -> DataFrame:
    """All pairs (src, dst, score) with cosine ``least`` or more, each once, ``src`` the smaller key; exact.

    See ``sparse_pairs``. Pass one row of each group of equal vectors: copies are
    members of a class, not pairs. ``pivots`` is not used any more.
    """
    rows = _usable(vectors, key, vector, dims, "key")
    return sparse_pairs(rows.mapInArrow(_sparse(dims), f"key {vectors.schema[key].dataType.simpleString()}, places array<smallint>, parts array<double>"), "key", dims, least)


def sparse_pairs(rows: DataFrame, key: str, dims: int, least: float = 0.95) -> DataFrame:
    """``similar_pairs`` of vectors given by the ``places`` and ``parts`` (numbers of any kind) of what isn't zero in them.

    Rows are packed and stored, once: packs meet as a product of the stored table
    with itself, which reads files again instead of shuffling rows. A pack is listed
    for each of the blocks, by whose order two packs meet once only. Rows of a pack
    are put in tiles of near ones, which are left out where their boxes lie too far
    apart; others are compared by projections, first on ``FIRST_AXES`` axes, then on
    ``AXES``, whose products bound the cosine from above, and what reaches the bound
    by the vectors. Comparisons grow with the square of the rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = rows.sparkSession, rows.schema[key].dataType
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "places", "parts")
    packs = numbered(own.mapInArrow(_packs(PACK_ROWS), "rows binary, n int"), "pack", "packs")
    n, n_packs = packs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    held = spark.sparkContext.broadcast(_axes_of(packs, n, dims))
    blocks = max(1, -(-n // PAIR_ROWS), min(PAIR_BLOCKS, -(-n // ROWS_EACH)))
    dealt = packs.coalesce(max(PAIR_SPLITS, n_packs // SIDES)).select("pack", "rows", F.pmod(F.xxhash64("pack"), F.lit(blocks)).cast("int").alias("block"))
    listed = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block <= with")
    others = dealt.select(F.col("pack").alias("with_pack"), F.col("rows").alias("with_rows"), F.col("block").alias("with_block"))
    met = listed.hint("shuffle_replicate_nl").join(others, (F.col("with") == F.col("with_block")) & ((F.col("block") < F.col("with")) | (F.col("pack") <= F.col("with_pack"))))
    work = _pack_pairs(held, dims, least, to_arrow_type(kind), TILE, FIRST_AXES, SIDES)
    return met.select("pack", "rows", "with_pack", "with_rows").mapInArrow(work, f"src {kind.simpleString()}, dst {kind.simpleString()}, score double")


def _unpacked(packed: pa.Buffer, dims: int) -> tuple[list, np.ndarray]:
    """Keys and vectors of a pack, those of whole numbers without what these have in common: vectors of one direction are equal."""
    rows = pa.ipc.open_stream(packed).read_all().combine_chunks()
    places, parts = (rows.column(x).combine_chunks() for x in ("places", "parts"))
    out = np.zeros((len(rows), dims))
    sizes, values = pc.list_value_length(places).to_numpy(), parts.flatten().to_numpy()
    if values.dtype.kind == "i" and len(values):
        full = sizes > 0
        least = np.gcd.reduceat(values, (np.cumsum(sizes) - sizes)[full])
        values = values // np.repeat(np.maximum(least, 1), sizes[full])
    out[np.repeat(np.arange(len(rows)), sizes), places.flatten().to_numpy()] = values
    return rows.column("key").to_pylist(), out


def nearest_sparse(queries: DataFrame, query_key: str, rows: DataFrame, key: str, dims: int, top_k: int = 8) -> DataFrame:
    """``nearest_each`` by cosine, of queries and rows given by ``places`` and ``parts``; none may be zero.

    Packs of queries are stored and meet the rows, packed where they are read:
    these go through no shuffle. Of parts in whole numbers the products are exact,
    so vectors of one direction have equal scores.
    """
    schema, query_type, key_type = _types(queries, query_key, rows, key)
    packs = lambda df, name, most: df.select(F.col(name).alias("key"), "places", "parts").mapInArrow(_packs(most), "rows binary, n int")
    asked = stored(packs(queries, query_key, QUERIES_EACH).select(F.col("rows").alias("asked")), "asked").coalesce(1)
    met = packs(rows, key, PACK_ROWS).select("rows").hint("shuffle_replicate_nl").crossJoin(asked)

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                keys, own = _unpacked(batch.column("rows")[n].as_buffer(), dims)
                names, wanted = _unpacked(batch.column("asked")[n].as_buffer(), dims)
                lengths, out = np.sqrt((own * own).sum(axis=1)), ([], [], [])
                for at in range(0, len(names), 64):
                    some = wanted[at : at + 64]
                    found = some @ own.T / (np.sqrt((some * some).sum(axis=1))[:, None] * lengths[None, :])
                    for name, score in zip(names[at : at + 64], found, strict=True):
                        best = _top(score, keys, top_k)
                        out[0].extend([name] * len(best))
                        out[1].extend(keys[i] for i in best)
                        out[2].extend(score[best].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], query_type), pa.array(out[1], key_type), pa.array(out[2], pa.float64())], names=["query", "key", "score"])

    return best_of(met.mapInArrow(run, schema), top_k, F.desc("score"), "key")


def _axes_of(packs: DataFrame, n: int, dims: int) -> _Axes:
    """From about ``PAIR_SAMPLE`` rows: some of each pack; whichever they are, the bounds hold."""
    step = max(1, n // PAIR_SAMPLE)

    def summed(batches):
        total = np.zeros((dims, dims), np.float32)
        for batch in batches:
            for packed in batch.column("rows"):
                units = _unpacked(packed.as_buffer(), dims)[1][::step]
                norms = np.linalg.norm(units, axis=1)
                units /= np.where(norms > 0, norms, 1)[:, None]
                total += units.T @ units
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["product"])

    total = np.zeros((dims, dims))
    for r in packs.coalesce(PAIR_SPLITS).mapInArrow(summed, "product binary").collect():  # a matrix for a partition
        total += np.frombuffer(bytes(r["product"]), np.float32).reshape(dims, dims)
    return _Axes(np.linalg.eigh(total)[1][:, ::-1][:, :AXES])
