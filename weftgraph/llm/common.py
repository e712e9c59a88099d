"""What several operators share: scratch tables, Arrow batches, packing, words."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract here has it (Java and Python read it alike).
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that numpy code works on at once; bounds a worker's memory.
SLICE_BYTES = 2 << 20
#: Most buckets that a map task splits its dictionary into.
MOST_BUCKETS = 4096
#: Text bytes of a block, the unit that has its own word list; an input partition is one block or several.
BLOCK_BYTES = 48 << 20
#: Keys with more than 1 / HOT_SHARE of all rows are hot: there are fewer than HOT_SHARE of them, whatever the data.
HOT_SHARE = 1000
#: Narrow rows that one task may always work on: smaller tables aren't looked through for hot keys.
FEW = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only a local master, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    set_dir = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftgraph/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores until no column is called so (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(df: DataFrame, *own: str) -> DataFrame:
    """Renames columns called like one that the operator adds: they get an underscore more."""
    for name in own:
        for c in df.columns:
            if c.lower() == name.lower():
                df = df.withColumnRenamed(c, free([*df.columns, *own], c))
    return df


def hot_join(rows: DataFrame, lookup: DataFrame, key: str, n: str = "n", total: int | None = None) -> DataFrame:
    """Inner join with a table that has each key once and counts its ``rows`` in ``n``.

    Hot keys (fewer than ``HOT_SHARE``, by counting) are joined by a broadcast, so
    none of them makes a task; all others meet by a shuffle. Both tables are read
    twice: pass stored ones. Null keys match nothing.
    """
    total = (lookup.agg(F.sum(n)).first()[0] or 0) if total is None else total
    if total <= FEW:
        return rows.join(lookup.drop(n), key)
    hot = lookup.where(F.col(n) * HOT_SHARE > total)
    if hot.isEmpty():
        return rows.join(lookup.drop(n), key)
    few, rest = F.broadcast(hot.drop(n)), lookup.where(F.col(n) * HOT_SHARE <= total).drop(n)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(rest, key))


def _murmur(values: np.ndarray) -> np.ndarray:
    """Spark's hash of ints: 32-bit Murmur 3 of four bytes with seed 42."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    k = turn(values.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


@lru_cache(maxsize=4)
def block_ids(rounds: int, width: int) -> np.ndarray:
    """``rounds`` times ``width`` distinct ints; a shuffle of ``width`` partitions by the int deals each to its place modulo width."""
    size = 2 * width * (rounds + 4)
    while True:
        place = _murmur(np.arange(size, dtype=np.int64)).astype(np.int64) % width
        counts = np.bincount(place, minlength=width)
        if counts.min() >= rounds:
            break
        size *= 2
    order = np.argsort(place, kind="stable")
    first = np.cumsum(counts) - counts
    return order[first[None, :] + np.arange(rounds)[:, None]].ravel().astype(np.int32)


def block_id(number: int, width: int) -> int:
    """The id of the block of this number. So blocks are dealt evenly, not by chance; where a shuffle has another width, by hash."""
    return int(block_ids(1 << (number // width).bit_length(), width)[number])


def ship(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to all executors; returns what ``local`` finds it by there."""
    import os

    name = os.path.basename(path)
    if name not in _shipped.setdefault(spark.sparkContext.applicationId, {}):
        spark.sparkContext.addFile(path)
        _shipped[spark.sparkContext.applicationId][name] = path
    same = _shipped[spark.sparkContext.applicationId][name] == path
    return name if same else path


_shipped: dict[str, dict[str, str]] = {}


def local(path: str) -> str:
    """Where a worker has the file: what was shipped, else the path itself."""
    import os

    from pyspark import SparkFiles

    if os.path.isabs(path):
        return path
    return SparkFiles.get(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(spark: SparkSession) -> int:
    return min(MOST_BUCKETS, shuffle_partitions(spark))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """Deals out an input of fewer partitions than cores (one small or unsplittable file)."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() * 2 > cores:
        return docs
    return docs.repartition(cores, F.xxhash64("doc_id"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``most`` bytes of ``column``; a longer row stays whole."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def blocks(batches: Iterator[pa.RecordBatch], column: str, parts: int, width: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a partition's rows with the id of their block: about ``BLOCK_BYTES`` of text after the other.

    ``column`` has the partition's number, one of ``parts``.
    """
    import pyarrow.compute as pc

    held, turn = 0, 0
    for batch in batches:
        for part in slices(batch, "text", most):
            yield block_id(part.column(column)[0].as_py() + turn * parts, width), part
            held += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held > BLOCK_BYTES:
                held, turn = 0, turn + 1


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    """A table as one compressed value, so that a shuffle moves few and small rows."""
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write(table)
    return out.getvalue()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def release() -> None:
    """Gives memory that Arrow and the C library hold unused back to the system."""
    import ctypes
    import sys

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL("libc.so.6").malloc_trim(0)
