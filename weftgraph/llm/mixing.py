"""Mixing sources to target weights by systematic sampling.

Within a source every document's expected copies are target / source size. The
documents stand in an order; the prefix sum of the expected copies, moved by
one random offset of the source, crosses integers, and a document is emitted
once for each integer that it crosses.

The order is by size (words), then by a seeded hash: neighbours are alike in
size, and the words taken miss the target by less than the largest document.
The offset is one seeded draw, taken whatever comes out, so a document's mean
copies over seeds are its expected copies.

Prefix sums come from counts: documents are ranked inside small cells of
(source, size, hash range), and cells are summed by source, so no task sees a
source. Places and levels of the sources come from aggregates over the table of
sources; no task needs all of them, and the driver sees sums only.

Null text has size 0; a null source is a source of its own and comes last. A
source of size 0 has target 0 and takes nothing. Rows that share an id, and
repeated rows, are sampled each on their own; null ids are documents like
others. An empty table gives an empty mixture. Other columns, whatever their
names, come through ``mix`` as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3.0
#: Documents of one source and one size that are ranked in one task.
CELL_ROWS = 20_000
_LOW = (1 << 33) - 1


def sized(docs: DataFrame, *own: str | Column) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *own)


def ranked(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """A table with the place of each row in a total order, from 0, as ``name``.

    The sort deals the rows out by range; a row's place is its place in its
    range plus the rows of the ranges before, which are one number a partition.
    """
    own = stored(rows.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(name, 33)
    at, starts = 0, []
    for r in own.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r.part, at))
        at += r["count"]
    before = F.broadcast(own.sparkSession.createDataFrame(starts, "_part long, _start long"))
    return own.join(before, part == F.col("_part")).withColumn(name, F.col("_start") + F.col(name).bitwiseAND(F.lit(_LOW))).drop("_part", "_start")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """``source``, ``source_size``, ``docs`` and ``target`` of each source.

    All that the bounded sources leave is shared by weight among the others, at
    a level L: target = min(bound, L * weight). Sources whose share is above
    their bound join the bounded ones until there are none.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by = ranked(by, "place", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    by = stored(by.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most_times))), "sources")
    total, shares = by.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level, bounded = (total / shares if shares else 0.0), 0
    while True:
        over = F.col("bound") < F.col("weight") * F.lit(level)
        n, held, left = by.agg(F.count_if(over), F.sum(F.when(over, F.col("bound"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == bounded or not left:
            break
        bounded, level = n, (total - (held or 0.0)) / left
    target = F.least(F.col("bound"), F.col("weight") * F.lit(level))
    return by.select("source", "source_size", "docs", target.cast("double").alias("target"))


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: float = MOST_TIMES, seed: int = 17, own: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``copies`` of every row, and its columns ``own``, which break ties."""
    rows = sized(docs, F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"), *own)
    rows = stored(rows, "sizes")  # narrow; read three times
    goals = targets(rows, weights, most_times)
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.withColumn("cells", F.ceil(F.col("n") / CELL_ROWS).cast("long"))
    same = F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size"))
    # Seeded hashes deal the copies of one size to cells in the order of the hash.
    unit = (F.shiftrightunsigned("draw", 33).cast("double") / float(1 << 31))
    dealt = rows.alias("r").join(cells.alias("c"), same).select("r.*", F.floor(unit * F.col("c.cells")).alias("cell"))
    per_cell = dealt.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("size", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_cell.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "size", "cell").orderBy("draw", "doc_id", *own)
    ranked = dealt.withColumn("rank", F.row_number().over(inside))
    placed = ranked.alias("r").join(starts.alias("s"), same_cell()).select("r.*", (F.col("s.start") + F.col("r.rank")).alias("position"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most_times)))).otherwise(F.lit(0.0))
    # One offset a source: a seeded hash as a fraction.
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.coalesce("source", F.lit("")), F.isnull("source")), 33).cast("double") / float(1 << 31)
    goals = goals.withColumn("rate", rate).withColumn("offset", offset)
    met = placed.alias("p").join(goals.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")))
    rate, offset, position = F.col("g.rate"), F.col("g.offset"), F.col("p.position")
    crossed = F.floor(position * rate + offset) - F.floor((position - 1) * rate + offset)
    taken = F.least(crossed, F.lit(int(most_times))).cast("long")
    return met.select("p.doc_id", "p.source", "p.size", "g.source_size", "g.target", taken.alias("copies"), *(f"p.{c}" for c in own))


def same_cell():
    return F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.size") == F.col("s.size")) & (F.col("r.cell") == F.col("s.cell"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it is taken, in all its columns; rows that share a doc_id count apart."""
    tie, row, of, copy, times = (free([*docs.columns, "size", "draw"], c) for c in ("mix_tie", "mix_row", "mix_of", "mix_copy", "mix_times"))
    numbered = stored(docs.withColumns({tie: F.xxhash64(*docs.columns), row: F.monotonically_increasing_id()}), "numbered")
    taken = copies(numbered, own=(tie, row), **options).where("copies > 0").select(F.col(row).alias(of), F.col("copies").alias(times))
    joined = numbered.join(taken.hint("shuffle_hash"), F.col(row) == F.col(of))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))
    return joined.withColumn(copy, again).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mixture takes of it."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
