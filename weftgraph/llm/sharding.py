"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit in memory, by a
seeded hash. Pass two shuffles each bucket with Fisher-Yates and writes it. The
buckets one after the other are a random order of all records; cut into equal
runs it gives the shards, so their counts are at most one apart (law ``rows``).

Records are scattered by id and text, so the outcome hangs on the seed and not
on how the input is dealt out. Only where equal rows alone would make a bucket
of ``MOST_TIMES`` times its size are they scattered by their place in the input,
too; the list of such rows has 8 bytes for each 256 MB of them. Counts are those of the buckets as written: a bucket's start is a sum in
its group of ``GROUP`` buckets plus the group's start; the driver sees one
number a group (64 GB).

Null text has no bytes, null ids are ids like others. Equal rows get places of
their own. Records are not grouped: copies of a text are dealt like any other
records. An empty table gives an empty result. A column that is called like one
that ``shard`` adds (shard, slot) gets an underscore more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, free, scratch, stored

SHARDS = 40
BUCKET_BYTES = 16 << 20
#: Bytes that a record counts beside its text.
RECORD_BYTES = 16
#: A bucket holds equal rows of at most so many times its size.
MOST_TIMES = 16
#: Buckets whose counts are summed in one task.
GROUP = 4096


def _fisher_yates(seed: int, bucket: str, tie: str, place: str):
    def run(table: pa.Table) -> pa.Table:
        number = table.column(bucket)[0].as_py()
        # A fixed order first, so that the outcome doesn't hang on the order of arrival.
        order = pc.sort_indices(table.select(["doc_id", tie]), sort_keys=[("doc_id", "ascending"), (tie, "ascending")])
        places = np.array(order)
        np.random.Generator(np.random.PCG64([seed, number])).shuffle(places)
        out = table.take(pa.array(places))
        return out.append_column(place, pa.array(np.arange(len(places)), pa.int64())).drop_columns([tie])

    return run


def shard(docs: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = 7) -> DataFrame:
    """Writes all rows as Parquet under ``path``, a folder ``shard=k`` each, and reads them back.

    The files hold all columns and ``slot``, the place in the shard, from 0.
    """
    spark = docs.sparkSession
    docs = aside(docs, "shard", "slot")
    columns = docs.columns
    bucket, tie, place, start, at = (free([*columns, "shard", "slot"], c) for c in ("own_bucket", "own_tie", "own_place", "own_start", "own_at"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES
    n, total = docs.select(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    tied = F.xxhash64(F.coalesce("text", F.lit("")), F.isnull("text"))
    group = F.xxhash64("doc_id", tied)
    sizes = docs.select(group.alias("g"), size.cast("long").alias("size")).groupBy("g").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    large = [r.g for r in sizes.where((F.col("size") > MOST_TIMES * bucket_bytes) & (F.col("n") > 1)).select("g").toLocalIterator()]
    row = F.lit(0).cast("long")
    if large:
        row = F.when(group.isin(large), F.monotonically_increasing_id()).otherwise(row)
    scattered = F.pmod(F.xxhash64(F.lit(seed), "doc_id", tied, row), F.lit(buckets)).cast("long")
    rows = docs.select(*columns, tied.alias(tie), scattered.alias(bucket))
    schema = docs.select(*columns, F.lit(0).cast("long").alias(bucket), F.lit(0).cast("long").alias(place)).schema
    shuffled = stored(rows.groupBy(bucket).applyInArrow(_fisher_yates(seed, bucket, tie, place), schema), "buckets")
    counts = stored(shuffled.groupBy(F.col(bucket).alias("b")).agg(F.count(F.lit(1)).alias("n")), "bucket_counts")
    sums, before = [], 0
    for r in counts.groupBy(F.floor(F.col("b") / GROUP).alias("g")).agg(F.sum("n").alias("n")).orderBy("g").collect():
        sums.append((r.g, before))
        before += r.n
    groups = spark.createDataFrame(sums, "g long, before long")
    upto = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("g", F.floor(F.col("b") / GROUP)).withColumn("inside", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    starts = starts.join(F.broadcast(groups), "g").select(F.col("b").alias(bucket), (F.col("before") + F.col("inside")).alias(start))
    # The first n % shards shards have one row more.
    base, more = divmod(n, shards)
    placed = shuffled.join(starts.hint("broadcast") if buckets <= GROUP else starts, bucket).withColumn(at, F.col(start) + F.col(place))
    long = F.col(at) < more * (base + 1)
    rest = F.col(at) - more * (base + 1)
    of = F.when(long, F.floor(F.col(at) / (base + 1))).otherwise(more + F.floor(rest / max(base, 1)))
    slot = F.when(long, F.col(at) % (base + 1)).otherwise(rest % max(base, 1))
    placed = placed.select(*columns, slot.cast("long").alias("slot"), of.cast("int").alias("shard"))
    placed.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def report(docs: DataFrame) -> DataFrame:
    """Writes the shards and describes every record as its file has it."""
    read = shard(docs, scratch(docs.sparkSession, "shards"))
    text = F.coalesce("text", F.lit(""))
    return read.select(
        "doc_id",
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
