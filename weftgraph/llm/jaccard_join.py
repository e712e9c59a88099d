"""Size-aware heavy-light Jaccard join of shingle sets, and its components.

Sets of one digest are one class; one row of a class, found by its row number,
stands for it, so rows may share an id or have none. Classes that may link share
a key:

* A set of n shingles links only with sets that share c = ceil(percent n / 100) of its
  shingles, so in any total order the first n - c + k of both hold k common
  ones. The order is from rare to frequent: all shingles are counted, and bit
  maps tell which occur in two documents or more, in many, and in very many. A
  bit may be set by chance, never missing, so the maps decide speed and not the
  result; a shingle that is in no map occurs once and makes no key. The maps
  grow with the number of shingles up to ``MOST_BITS``; from there on more bits
  are set by chance, and shingles that occur once make keys in that measure.
* Light (small) sets enumerate all subsets of k = 2 of their prefix.
* Heavy (large) sets scan the inverted lists of their prefix shingles (k = 1);
  light sets near the boundary are listed there too.
* The boundary is the size at which, by the sizes of all sets and the mean list
  length, rows written plus list entries read cost least.

In each list the smallest member is a hub and is compared with the others; pairs
that already lie in one component need no comparison. Lists whose members still
lie in several components are gone through once more: those of up to ``DENSE``
members pair by pair, longer ones in blocks. A block is a task that has the texts
of one or two parts of a list, makes their sets once and compares every member
outside the most frequent component with all others, without a row for each pair.
So no link between components is lost; a group of n near copies of which m link
with none of the others costs about n m comparisons a list.

Keys, hubs, components and digests that many rows have are joined by a broadcast
of the few that do (``hot_join``), texts of hot hubs are repeated and their
partners dealt out over the copies, and the parts of a list are bounded by
``PART_SHINGLES``, so no task sees all rows of one.

Null or wordless text has an empty set and links with nothing. Repeated rows
are copies of each other; of rows that share an id each has its own links. Null
ids count least as names: a component is called by its smallest id, null if none
has one. An empty table gives an empty result; other columns, whatever their
names, are kept (``keep_one``) or not read. Words a shingle and the percentage
are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, HOT_SHARE, WORD, free, hot_join, pack, shuffle_partitions, slices, spread, stored, texts, unpack

#: Two sets link from PERCENT per cent of their union on; shingles have WORDS words. Defaults, those of op4.
PERCENT, WORDS = 85, 4
#: Documents that a shingle must occur in to be in each map.
LEAST_SEEN = (2, 16, 256)
#: The first map has one bit for two shingles, but 2 ** LEAST_BITS at least and 2 ** MOST_BITS (128 MB) at most; the others have an eighth.
LEAST_BITS, MOST_BITS = 27, 30
#: Shingles that a task holds before it sends them on.
HELD = 4_000_000
#: Larger sets count as this size when the boundary is chosen; it is below.
LARGEST = 1_000
#: Up to so many ids are broadcast to pick out texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Narrow rows that one task works on.
ROWS_EACH = 200_000
#: Longer lists are compared in blocks.
DENSE = 64
#: Shingles of a part of a long list; a block has two parts.
PART_SHINGLES = 2_000_000
_A = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The set of a text's shingles as sorted distinct 64-bit hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        whole = b" ".join(words)
        return np.array([xxhash.xxh3_64_intdigest(whole, seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = _mixed(h[:n]) * _A[0]
    for i in range(1, size):
        out = _mixed(out + h[i : i + n] * _A[i % len(_A)])
    return np.unique(out)


def needed(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of n that any set it links with must share."""
    return -(-percent * n // 100)


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def map_bits(total: int) -> tuple[int, int, int]:
    """Sizes of the maps (log2 of their bits) for so many shingles."""
    size = min(MOST_BITS, max(LEAST_BITS, (total // 2).bit_length()))
    return size, size - 3, size - 3


class Maps:
    """Which shingles are frequent, by the leading bits of their hash."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits

    def ranks(self, own: np.ndarray) -> np.ndarray:
        """0 for shingles in no map; more frequent ones have higher ranks."""
        out = np.zeros(len(own), np.uint8)
        for i, bits in enumerate(self.bits):
            size = (8 * len(bits)).bit_length() - 1
            at = (own >> np.uint64(64 - size)).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            out = out + hit if i == 0 else np.where(out == i, out + hit, out)
        return out


class Keys:
    """The keys of a set, given the maps and the boundary."""

    def __init__(self, maps: Maps, boundary: int, percent: int):
        self.maps, self.boundary, self.percent = maps, boundary, percent

    def each(self, sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self(own) for own in sets]

    def __call__(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and their places: a set has ``n - place`` shingles at most in common with one that shares this key first."""
        n = len(own)
        if 100 * n // self.percent == n:  # no other size is near enough, and an equal size only if all are shared
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        spare = n - needed(n, self.percent)
        ranks = self.maps.ranks(own)
        order = np.argsort(ranks, kind="stable")[: spare + 2]
        first, ranks = own[order], ranks[order]
        useful = ranks > 0
        keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        if n <= self.boundary:
            at = np.flatnonzero(useful).astype(np.int32)
            i, j = np.triu_indices(len(at), 1)
            low, high = np.minimum(first[at[i]], first[at[j]]), np.maximum(first[at[i]], first[at[j]])
            keys.append(_mixed(low * _A[1] + _mixed(high * _A[2])))
            places.append(at[j] - 1)
        if n > self.boundary or 100 * n >= self.percent * (self.boundary + 1):
            place = np.flatnonzero(useful[: spare + 1]).astype(np.int32)
            keys.append(first[place])
            places.append(place)
        return np.concatenate(keys).view(np.int64), np.concatenate(places)


def choose_boundary(sizes: np.ndarray, many: np.ndarray, list_length: float, percent: int = PERCENT) -> int:
    """The size up to which enumerating pairs of the prefix costs less than scanning lists.

    ``many`` sets have each of the ascending ``sizes``.
    """
    if not len(sizes):
        return 0
    spare = (sizes - -(-percent * sizes // 100)).astype(np.float64)
    subsets = np.concatenate([[0.0], np.cumsum(many * (spare + 2) * (spare + 1) / 2)])
    scans = many * (spare + 1) * (1 + list_length)
    scans = np.concatenate([np.cumsum(scans[::-1])[::-1], [0.0]])
    best = int((subsets + scans).argmin())
    return int(sizes[best - 1]) if best else 0


def _buckets(rows: int) -> int:
    """Leading bits of a shingle that deal it out for counting; 32 more are kept. A bucket has the shingles of 10,000 rows or so."""
    return min(20, max(8, (rows // 10_000).bit_length()))


_COUNTED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _counted(lead: int, words: int):
    """Leading bits of the shingles of a block by bucket, sorted, with their documents; bucket -1 has the sets' sizes."""

    def rows(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every, n = np.unique(np.concatenate(parts), return_counts=True)
        cuts = np.searchsorted(every, np.arange((1 << lead) + 1, dtype=np.uint64) << np.uint64(32))
        n = np.minimum(n, 0xFFFF).astype(np.uint16)
        for b in range(1 << lead):
            own = every[cuts[b] : cuts[b + 1]].astype(np.uint32)
            if len(own):
                steps = np.diff(own, prepend=np.uint32(0))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack(pa.table({"step": steps, "n": n[cuts[b] : cuts[b + 1]]}))], pa.binary())], schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        sizes = np.zeros(LARGEST + 2, np.int64)  # sets of each size; then all shingles
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, words) for t in texts(part.column("text"))]
                parts += [s >> np.uint64(32 - lead) for s in sets]
                sizes[:-1] += np.bincount([min(len(s), LARGEST) for s in sets], minlength=LARGEST + 1)
                many = sum(map(len, sets))
                sizes[-1] += many
                held += many
                if held > HELD:
                    yield from rows(parts)
                    parts, held = [], 0
        if parts:
            yield from rows(parts)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([pack(pa.table({"n": sizes}))], pa.binary())], schema=_COUNTED)

    return run


def _mapped(lead: int, sizes: tuple[int, int, int]):
    """Slices of the maps for each bucket, and what the counts add up to."""

    def done(bucket: int, steps: list, counts: list) -> Iterator[pa.RecordBatch]:
        own = np.concatenate(steps)
        order = np.argsort(own, kind="stable")
        own, n = own[order], np.concatenate(counts)[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        own, n = own[at], np.add.reduceat(n, at)
        out = []
        for i, (least, size) in enumerate(zip(LEAST_SEEN, sizes, strict=True)):
            chosen = n >= least
            bits = np.zeros(max(8, 1 << (size - lead)), np.uint8)
            bits[own[chosen] >> np.uint32(32 - (size - lead))] = 1
            out.append((bucket, i, int(n[chosen].sum()), int((n[chosen] ** 2).sum()), np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "map", "total", "squares", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, steps, counts = None, [], []
        for batch in batches:
            for of, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if of != bucket:
                    if bucket is not None:
                        yield from done(bucket, steps, counts)
                    bucket, steps, counts = of, [], []
                table = unpack(blob.as_py())
                steps.append(np.cumsum(table.column("step").to_numpy(), dtype=np.uint32))
                counts.append(table.column("n").to_numpy())
        if bucket is not None:
            yield from done(bucket, steps, counts)

    return run


def _added(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()


def survey(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> Keys:
    """Counts all shingles and sizes; the maps and the boundary that follow."""
    lead = _buckets(docs.count())
    counted = stored(docs.select("text").mapInArrow(_counted(lead, words), "bucket int, blob binary"), "shingle_counts")
    sizes = np.frombuffer(counted.where("bucket = -1").select("blob").rdd.map(lambda r: unpack(bytes(r.blob)).column("n").to_numpy().tobytes()).fold(bytes(8 * (LARGEST + 2)), _added), np.int64)
    sizes, every = sizes[:-1], int(sizes[-1])
    widths = map_bits(every)
    dealt = counted.where("bucket >= 0").repartition(shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    mapped = stored(dealt.mapInArrow(_mapped(lead, widths), "bucket int, map int, total long, squares long, bits binary"), "shingle_maps")
    loads = {r["map"]: r for r in mapped.groupBy("map").agg(*(F.sum(c).alias(c) for c in ("total", "squares"))).collect()}
    bits = []
    for i, size in enumerate(widths):
        whole = np.zeros(1 << (size - 3), np.uint8)
        width = max(1, (1 << (size - lead)) >> 3)
        own = mapped.where(F.col("map") == i).select("bucket", "bits").toArrow()  # the map's size in all
        for bucket, part in zip(own.column("bucket").to_pylist(), own.column("bits"), strict=True):
            whole[bucket * width : (bucket + 1) * width] = np.frombuffer(part.as_py(), np.uint8)[:width]
        bits.append(whole)
    # Prefixes hold the rarest shingles, so the lists that are scanned are those of the first map only.
    total, squares = (loads[0][c] - loads[1][c] if loads else 0 for c in ("total", "squares"))
    length = max(0.0, squares / max(1, total) - 1)
    own = np.flatnonzero(sizes)
    own = own[100 * own // percent > own]  # the others make no keys
    return Keys(Maps(bits), choose_boundary(own, sizes[own].astype(np.float64), length, percent), percent)


def _sketch(keys, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = keys.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, words) for t in texts(part.column("text"))]
                keyed = of.each(sets)
                digest = [sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([k for k, _ in keyed], pa.list_(pa.int64())), pa.array([p for _, p in keyed], pa.list_(pa.int32()))], names=["doc_id", "tie", "n_shingles", "digest", "keys", "places"])

    return run


@lru_cache(maxsize=8)
def _shingles_again(text: str, words: int) -> np.ndarray:
    return shingles(text, words)


def _verify(percent: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_b"):
                ok = [links(_shingles_again(x, words), shingles(y, words), percent) for x, y in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def width_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a table of so many narrow rows."""
    return min(shuffle_partitions(spark), 1 + rows // ROWS_EACH)


def _with_text(pairs: DataFrame, pool: DataFrame, side: str, hot: DataFrame | None) -> DataFrame:
    """Adds text and size of the members of a column; those of ``hot`` (member, copies) are repeated and their pairs dealt out."""
    own = pool.toDF(side, f"text_{side}", f"n_{side}")
    if hot is None:
        return pairs.join(own, side)
    few = F.broadcast(hot.toDF(side, "copies"))
    salted = pairs.join(few, side, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    again = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)).cast("int") - 1)).alias("salt")
    return salted.join(own.join(few, side, "left").select(side, f"text_{side}", f"n_{side}", again), [side, "salt"]).drop("salt")


def verified(pairs: DataFrame, pool: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) that link: sizes are compared before the second text is fetched."""
    pairs = stored(pairs.distinct(), "pairs")
    n = pairs.count()
    hot = {}
    for side in "ab":
        hot[side] = None
        if n > FEW:
            counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE > n)
            hot[side] = stored(counts.select(side, F.ceil(F.col("n") * HOT_SHARE / n).alias("copies")), "hot_members")  # fewer than HOT_SHARE rows
    width = width_for(pairs.sparkSession, 16 * n)  # rows with texts
    first = _with_text(pairs, pool, "b", hot["b"]).coalesce(width)
    near = _with_text(first, pool, "a", hot["a"]).where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return stored(near.select("a", "b", "text_a", "text_b").coalesce(width).mapInArrow(_verify(percent, words), "a long, b long"), "links")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable id, by alternating large and small stars.

    Every round is written to the shared folder; nothing is collected.
    """
    n = edges.count()
    width = width_for(spark, n)
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")

    def met(rows: DataFrame, least: DataFrame, name: str) -> DataFrame:
        return hot_join(rows, stored(least, name) if 2 * n > FEW else least, "u", total=2 * n)

    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")).coalesce(width)
        large = met(both, least, "least").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(width)
        large = stored(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).coalesce(width)
        small = met(large, low, "low").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        stars = stored(small.distinct().coalesce(width), "stars")
        # Done when each node points to one other that points to none.
        ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(stars.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).coalesce(width)
        if not degrees.where("out > 1 or out = 1 and into = 1").count():
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    joined = rows.drop("component").join(comps.withColumnRenamed("node", "member"), "member", "left")
    return joined.withColumn("component", F.coalesce("component", "member"))


def _open(rows: DataFrame) -> DataFrame:
    """The rows of lists whose members lie in more than one component, but those of hubs, which are done."""
    left = rows.where("member <> hub").drop("hub")
    lists = left.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("early").alias("some"), F.count(F.lit(1)).alias("of"))
    several = stored(lists.where("c0 <> c1 and some").select("key", "of"), "open_lists")
    return hot_join(left, several, "key", "of")


def _list_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of a short list that may link."""
    # At the first shingle that two sets share, all they may share is what follows in both.
    possible = (100 + percent) * F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= percent * (F.col("x.n") + F.col("y.n"))
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.member") < F.col("y.member")))
    met = rows.where("early").alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & ordered & (F.col("x.component") != F.col("y.component")) & possible)
    return met.select(F.col("x.member").alias("a"), F.col("y.member").alias("b"))


def _block_links(percent: int, words: int):
    """Links of a block between components, but for those that follow from others of the block."""

    def run(block: pa.Table) -> pa.Table:
        members, part = block.column("member").to_numpy(), block.column("part").to_numpy()
        _, component = np.unique(block.column("component").to_numpy(), return_inverse=True)
        sets = [shingles(t, words) for t in block.column("text").to_pylist()]
        n = np.array([len(x) for x in sets])
        names, every = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(n) - n
        one_part = block.column("lo")[0] == block.column("hi")[0]
        a, b = [], []
        for x in np.flatnonzero(component != np.bincount(component).argmax()):
            wanted = (component != component[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
            if not one_part:
                wanted &= part != part[x]
            if not wanted.any():
                continue
            own = np.zeros(len(names), np.int32)
            own[every[starts[x] : starts[x] + n[x]]] = 1
            common = np.add.reduceat(own[every], starts)
            for y in np.flatnonzero(wanted & (100 * common >= percent * (n + n[x] - common))):
                if component[y] != component[x]:
                    a.append(members[x])
                    b.append(members[y])
                    component[component == component[y]] = component[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _dense_links(rows: DataFrame, sizes: DataFrame, pool: DataFrame, percent: int, words: int) -> DataFrame:
    """Links of long lists, by blocks: ``sizes`` has the shingles (``held``) of each."""
    cuts = sizes.select("key", F.ceil(F.col("held") / PART_SHINGLES).cast("int").alias("parts"))
    dealt = rows.select("key", "member", "component").join(cuts, "key").join(pool.select("member", "text"), "member")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = dealt.select("key", "member", "component", "text", "part", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"))
    return blocks.groupBy("key", "lo", "hi").applyInArrow(_block_links(percent, words), "a long, b long")


def link_components(keys: DataFrame, pool_of, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Components of the classes: ``node`` and ``component`` of those that link with another class.

    ``keys`` has ``key``, ``member``, its size ``n`` and the key's ``place``. ``pool_of`` gives member, text and n of the members asked for.
    """
    spark = keys.sparkSession
    # A pair's smaller set has their first common shingle so early that enough follows; lists without such a member hold no pair.
    keys = keys.withColumn("early", (100 + percent) * (F.col("n") - F.col("place")) >= 2 * percent * F.col("n"))
    lists = keys.groupBy("key").agg(F.min(F.when(F.col("early"), F.col("member"))).alias("hub"), F.min("member").alias("first"), F.max("member").alias("last"), F.count(F.lit(1)).alias("of"))
    lists = stored(lists.where("first < last and hub is not null").select("key", "hub", "of"), "hubs")
    rows = stored(hot_join(keys, lists, "key", "of"), "lists")
    pool = pool_of(rows.select("member", "n").distinct())
    pairs = rows.where("member <> hub").select(F.col("hub").alias("a"), F.col("member").alias("b"))
    found = verified(pairs, pool, percent, words)
    comps = components(spark, found)
    rows = stored(_open(_with_component(rows, comps)), "lists")
    sizes = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("held")), "list_sizes")
    if sizes.isEmpty():
        return comps
    dense = sizes.where(F.col("of") > DENSE)
    short = rows.join(sizes.where(F.col("of") <= DENSE).select("key"), "key", "left_semi")
    new = verified(_list_pairs(short, percent), pool, percent, words)
    if not dense.isEmpty():
        new = new.unionByName(stored(_dense_links(rows, dense, pool, percent, words), "dense_links"))
    return components(spark, new.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, keys=None) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    ``keys`` may give the keys of sets by another rule (``each``, like ``Keys``); links are confirmed all the same.
    """
    spark = docs.sparkSession
    source = spread(docs.select("doc_id", "text"))
    keys = spark.sparkContext.broadcast(survey(source, percent, words) if keys is None else keys)  # maps of bounded size
    tied = source.withColumn("tie", F.xxhash64("text"))
    made = tied.mapInArrow(_sketch(keys, words), "doc_id long, tie long, n_shingles long, digest binary, keys array<long>, places array<int>")
    sketches = stored(made.withColumn("row", F.monotonically_increasing_id()), "sketches")  # numbers are fixed by being written
    classes = stored(sketches.where("digest is not null").groupBy("digest").agg(F.min("row").alias("member"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    chosen = sketches.where("size(keys) > 0").select("row", "n_shingles", "keys", "places").join(classes.select("member").hint("shuffle_hash"), F.col("row") == F.col("member"), "left_semi")
    exploded = chosen.select(F.explode(F.arrays_zip("keys", "places")).alias("k"), "row", "n_shingles").selectExpr("k.keys as key", "k.places as place", "row as member", "n_shingles as n")

    def pool_of(members: DataFrame) -> DataFrame:
        """Texts are fetched by id and hash; rows that equal the one that stands for a class go."""
        ids = stored(members.join(sketches.select(F.col("row").alias("member"), F.col("doc_id").alias("of"), F.col("tie").alias("wanted")), "member").withColumn("at", F.xxhash64("of", "wanted")), "ids")
        few = ids.count() <= BROADCAST_IDS
        rows = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text")).withColumn("at", F.xxhash64("doc_id", "tie"))
        met = rows.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "at").where(F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("wanted")))
        return stored(met.dropDuplicates(["at", "member"]).select("member", "text", "n"), "pool")

    comps = link_components(exploded, pool_of, percent, words)
    named = stored(classes.join(comps, F.col("member") == F.col("node"), "left").select("digest", "least", "n", F.coalesce("component", "member").alias("component")), "named")
    names = stored(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("many")), "names")
    of_class = stored(hot_join(named.select("digest", "n", "component"), names, "component", "many").select("digest", "n", "component_id"), "of_class")
    rows = sketches.select("doc_id", "n_shingles", "digest")
    alone = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return hot_join(rows, of_class, "digest").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row of each component, in all columns: that of the smallest doc_id, and among rows that share it, of the smallest hash.

    Rows are told apart by a number of their own, so doc_id may be null (these
    come last) or reused: a row goes only if one of its component stays. A row
    without words goes only if another equals it in all columns.
    """
    row, of = free(docs.columns, "own_row"), free(docs.columns, "own_of")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = join(numbered.select(F.col(row).alias("doc_id"), "text"), percent, words).where("n_shingles > 0").select(F.col("doc_id").alias(of), "component_id")
    place = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), F.col(row).alias("row"))
    kept = found.join(numbered.select(F.col(row).alias(of), place.alias("place")), of).groupBy("component_id").agg(F.min("place")["row"].alias(of)).select(of)
    wordless = numbered.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).groupBy(*docs.columns).agg(F.min(row).alias(of)).select(of)
    rows = numbered.join(kept.unionByName(wordless).hint("shuffle_hash"), F.col(row) == F.col(of), "left_semi")
    return rows.select(*docs.columns)
