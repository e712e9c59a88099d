"""Prefix trie of conversations by a range sort, adjacent prefixes, and stack sweeps.

A conversation is the array of its turns, each turn a 16-byte digest of role and
text; the concatenated digests are its key, and texts never move. Keys are sorted
globally by range (ties by conv_id, so copies of one conversation are dealt over
partitions). Each partition is swept once in order: the longest common prefix of
neighbouring keys tells which nodes are complete; these leave the stack and are
written, folded into the node above.

Nodes on the path of a partition's first or last key may go on in its neighbours:
their parts, one open stack on either side of a partition, are a short summary.
``_stitch`` goes through the summaries in order (their number is that of the
partitions), merges open nodes and closes them. A node whose parent closed
later asks for the parent's name by its prefix digest (``hot_join``: a parent of
very many children is broadcast).

The hash of a node's ends is taken as their ids go by. Where a group of equal keys
is a partition's first or last, or has more than ``RUN`` members, its ids are
written in runs of up to ``RUN`` and hashed in order afterwards. SHA-256 of one
string is sequential by nature, so one task streams the ids of one such node, in
bounded memory.

A task holds one conversation's digests and one stack as deep as the longest
conversation (about 20 and 300 bytes a turn), never a text. Spark samples keys on
the driver to find the ranges (about 100 a partition).

Turns are taken by number, null first; of equal numbers by digest, so repeated
rows are turns of their own. Null role or text counts as empty. Rows without a
conv_id belong to no conversation and are left out. An empty table gives no node.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hot_join, shuffle_partitions, stored

#: Bytes of a turn in a key.
TURN = 16
#: Ids of one run of the ends of a node.
RUN = 1 << 16
#: Rows of a batch of nodes.
BATCH = 20_000
#: Conversations of GROUP following ids share the beginning of the first of them, up to so many turns.
GROUP, SHARED = 20, 3
_NONE = sha256(b"").hexdigest()
_SWEPT = pa.schema(
    [("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64())]
    + [("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("part", pa.int32()), ("seq", pa.int32()), ("blob", pa.binary())]
)
_DDL = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary, part int, seq int, blob binary"
#: Kinds of rows that a sweep makes.
NODE, SUMMARY, ENDS = 0, 1, 2


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, its turns in order: (turn, digest, words)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN))
    rows = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_beginnings(arrays: DataFrame, group: int = GROUP, most: int = SHARED) -> DataFrame:
    """Each conversation c with its first h turns put in place by those of c - c % group; h = crc32(c) modulo most + 1.

    At most ``group`` conversations ask for one beginning.
    """
    heads = arrays.select(F.col("conv_id").alias("of"), F.slice("turns", 1, most).alias("head"))
    met = arrays.join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("of"), "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    none = F.slice("turns", 1, 0)
    return met.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def key_of(turns: Column) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), ""))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix of two keys."""
    most = min(len(a), len(b)) // TURN
    if a[: most * TURN] == b[: most * TURN]:
        return most
    low, high = 0, most  # the first ``low`` turns agree, the first ``high`` don't
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle
    return low


class Node:
    """An open node: what its closed children and its own ends add up to."""

    __slots__ = ("conv", "n", "kids", "leaves", "saved", "words", "ends", "left")

    def __init__(self, words: int, left: bool):
        self.conv, self.n, self.kids, self.leaves, self.saved, self.words, self.ends, self.left = None, 0, 0, 0, 0, words, None, left

    def add(self, conv: int | None, n: int) -> None:
        self.n += n
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv

    def close(self) -> None:
        self.saved += (self.n - 1) * self.words
        self.leaves = self.leaves or 1

    def take(self, kid: Node) -> None:
        self.add(kid.conv, kid.n)
        self.kids += 1
        self.leaves += kid.leaves
        self.saved += kid.saved

    def merge(self, part: Node) -> None:
        """Adds what another partition knows of the same node."""
        self.add(part.conv, part.n)
        self.kids, self.leaves, self.saved = self.kids + part.kids, self.leaves + part.leaves, self.saved + part.saved
        self.ends = part.ends if self.ends is None else self.ends

    def state(self) -> tuple:
        return tuple(getattr(self, c) for c in self.__slots__)

    @classmethod
    def of(cls, state: tuple) -> Node:
        made = cls(0, False)
        for c, x in zip(cls.__slots__, state, strict=True):
            setattr(made, c, x)
        return made


class Stack:
    """Open nodes by depth on the path of ``key``, their prefix digests as far as they were asked for, and rows to write."""

    def __init__(self, part: int):
        self.part, self.key, self.nodes, self.names, self.rows = part, b"", [], [bytes(TURN)], []

    def name(self, depth: int) -> bytes:
        for k in range(len(self.names), depth + 1):
            self.names.append(sha256(self.names[-1] + self.key[(k - 1) * TURN : k * TURN]).digest()[:TURN])
        return self.names[depth]

    def move(self, key: bytes, shared: int) -> None:
        """The path goes on along another key, the first ``shared`` turns of which are those of this one."""
        del self.names[shared + 1 :]
        self.key = key

    def write(self, kind: int, conv=None, depth=None, parent_conv=None, n=None, kids=None, leaves=None, saved=None, ends=None, node=None, parent=None, seq=None, blob=None) -> None:
        self.rows.append((kind, conv, depth, parent_conv, n, kids, leaves, saved, ends, node, parent, self.part, seq, blob))

    def close_to(self, depth: int, keep: list | None = None) -> None:
        """Closes all nodes below ``depth``, deepest first; nodes open on the left go to ``keep`` instead, if it is given."""
        closed: list[Node] = []
        while len(self.nodes) - 1 > depth:
            own = self.nodes.pop()
            if keep is not None and own.left:
                keep.append(own)
            else:
                own.close()
                if self.nodes:
                    self.nodes[-1].take(own)
            closed.append(own)
        top = depth + 1
        for k, own in zip(range(top + len(closed) - 1, depth, -1), closed, strict=True):
            if keep is not None and own.left:
                continue
            above = closed[len(closed) - 1 - (k - 1 - top)] if k > top else None
            known = above is not None and not (keep is not None and above.left)
            asked = own.kids > 0 and own.n > 1
            self.write(NODE, own.conv, k, above.conv if known else None, own.n, own.kids, own.leaves, own.saved, _NONE if own.ends is None else own.ends, self.name(k) if asked or own.ends == "" else None, None if known or k == 0 else self.name(k - 1))

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SWEPT, strict=True)], schema=_SWEPT)
            self.rows = []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete nodes of a sorted partition, the summary of its open ones, and runs of ends that may go on elsewhere."""
    stack: Stack | None = None
    first_key, lefts, hasher, ids, seq = b"", [], None, [], 0

    def flush() -> None:
        nonlocal ids, seq
        if ids:
            depth = len(stack.key) // TURN
            stack.write(ENDS, node=stack.name(depth), seq=seq, blob=np.array(ids, np.int64).tobytes())
            stack.nodes[depth].ends = ""
            seq += 1
        ids = []

    def group_ends(last: bool) -> None:
        """The group of the current key has no more rows here."""
        if last or stack.key == first_key or stack.nodes[-1].ends == "":
            flush()
        else:
            stack.nodes[-1].ends = hasher.hexdigest()

    for batch in batches:
        part = batch.column("part")
        for i, (conv, key, words) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("key").to_pylist(), batch.column("words").to_pylist(), strict=True)):
            if stack is None:
                stack, first_key = Stack(part[i].as_py()), key
                stack.move(key, 0)
                stack.nodes = [Node(0, True), *(Node(w, True) for w in words)]
                hasher = sha256()
            elif key != stack.key:
                group_ends(last=False)
                shared = common_turns(stack.key, key)
                stack.close_to(shared, lefts)
                stack.move(key, shared)
                stack.nodes += [Node(w, False) for w in words[shared:]]
                hasher, ids, seq = sha256(), [], 0
            stack.nodes[-1].add(conv, 1)
            hasher.update((b"," if stack.nodes[-1].n > 1 else b"") + str(conv).encode())
            ids.append(conv)
            if len(ids) >= RUN:
                flush()
        yield from stack.batches(BATCH)
    if stack is not None:
        group_ends(last=True)
        summary = (first_key, stack.key, [x.state() for x in lefts], [x.state() for x in stack.nodes])
        stack.write(SUMMARY, blob=pickle.dumps(summary))
        yield from stack.batches(1)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the open nodes of the partitions, in order, and closes them."""
    stack = Stack(-1)
    for batch in batches:
        for blob in batch.column("blob"):
            first_key, last_key, lefts, rest = pickle.loads(blob.as_py())
            both = sum(1 for s in rest if s[-1])  # open on either side
            first = [Node.of(s) for s in [*rest[:both], *reversed(lefts)]]
            shared = common_turns(stack.key, first_key) if stack.nodes else -1
            stack.close_to(shared)
            stack.move(first_key, max(shared, 0))
            for k, own in enumerate(first):
                if k <= shared:
                    stack.nodes[k].merge(own)
                else:
                    stack.nodes.append(own)
            stack.close_to(both - 1)
            stack.move(last_key, both - 1)
            stack.nodes += [Node.of(s) for s in rest[both:]]
            yield from stack.batches(BATCH)
    stack.close_to(-1)
    yield from stack.batches(1)


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes the ids of each node's runs, which come in order."""
    node, hasher, names, hashes = None, None, [], []
    for batch in batches:
        for own, blob in zip(batch.column("node").to_pylist(), batch.column("blob"), strict=True):
            if own != node:
                if node is not None:
                    names.append(node)
                    hashes.append(hasher.hexdigest())
                node, hasher, comma = own, sha256(), b""
            hasher.update(comma + ",".join(map(str, np.frombuffer(blob.as_py(), np.int64).tolist())).encode())
            comma = b","
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hashes, pa.string())], names=["node", "hash"])
        names, hashes = [], []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([hasher.hexdigest()], pa.string())], names=["node", "hash"])


def trie(arrays: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each node of the trie of ``arrays`` (conv_id, turns).

    ``conv_id`` is the smallest member's, ``parent_conv_id`` the parent's; ``depth``,
    ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes of the
    subtree), ``saved_tokens`` (words that members beyond the first repeat, of all
    nodes of the subtree) and ``ends_sha256`` (of the ids that end here, ascending).
    """
    spark = arrays.sparkSession
    width = partitions or shuffle_partitions(spark)
    keyed = arrays.select("conv_id", key_of(F.col("turns")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    in_order = keyed.repartitionByRange(width, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())
    swept = stored(in_order.mapInArrow(_sweep, _DDL), "swept")
    summaries = swept.where(F.col("kind") == SUMMARY).select("part", "blob").repartition(1).sortWithinPartitions("part")  # one a partition
    stitched = stored(summaries.mapInArrow(_stitch, _DDL), "stitched")
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node", "parent"]
    nodes = swept.where(F.col("kind") == NODE).select(*own).unionByName(stitched.select(*own))
    runs = swept.where(F.col("kind") == ENDS).select("node", "part", "seq", "blob")
    hashed = runs.repartition("node").sortWithinPartitions("node", "part", "seq").mapInArrow(_hash_runs, "node binary, hash string")
    split = nodes.where("ends_sha256 = ''").join(hashed, "node").withColumn("ends_sha256", F.col("hash")).select(*own)
    nodes = nodes.where("ends_sha256 <> ''").unionByName(split)
    asked = nodes.where("parent is not null")
    names = nodes.where("node is not null and n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("of"), F.col("n_children").alias("n"))
    met = hot_join(asked, names, "parent").withColumn("parent_conv_id", F.col("of"))
    out = [c for c in own if c not in ("node", "parent")]
    return nodes.where("parent is null").select(*out).unionByName(met.select(*out))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with shared beginnings."""
    return trie(with_shared_beginnings(turn_arrays(conversations)))
