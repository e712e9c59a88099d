"""BPE encoding through a distinct-word table, and decoding.

Words are the pieces that the tokenizer's own splitter makes. Each block of
documents (about ``BLOCK_BYTES`` of an input partition) states its distinct
words; they are dealt by word, every distinct word is encoded once, and its ids
go back to the blocks that asked. There they are joined to the words by
position. What is shuffled are packed lists of distinct words and the texts,
never a row per word. Blocks are dealt evenly to tasks (``block_id``).

Decoding joins ids to the id-to-piece table: the table is sorted by id without a
gap, so the join of a batch of ids is a gather, and the pieces of a row are then
put together in order. The table has as many rows as the vocabulary.

The distinct-word way holds for byte-level BPE with the published splitting
pattern and one special string; the file's settings are read, and any other
tokenizer encodes and decodes whole texts by the library (``plain``).

Null text is empty: no ids. A word that a block did not ask for (its partition
was dealt anew after a lost executor) is encoded on the spot, with equal ids.
Repeated rows and rows that share an id are encoded each on its own; an empty
table gives an empty result. Kept columns called like one that is added (ids,
decoded) get an underscore more.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, blocks, buckets_for, free, local, pack, release, shuffle_partitions, ship, slices, spread, texts, unpack

SPECIAL = "<|endoftext|>"
#: Distinct words that a task holds before it sends them on.
HELD = 600_000
#: The published splitting pattern of byte-level BPE, with Unicode white space spelled out.
_SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Beyond these characters Unicode versions differ in what is a letter; the library then splits itself.
_OTHER = regex.compile(r"[^\x00-\u02FF\u2010-\u2027\u2030-\u205E\u20AC]")


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer of a ``.json`` file, without truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(local(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def plain(path: str) -> bool:
    """Whether the file is byte-level BPE that words can be encoded for one by one."""
    with open(local(path), encoding="utf-8") as f:
        own = json.load(f)
    model, splitter, decoder = (own.get(k) or {} for k in ("model", "pre_tokenizer", "decoder"))
    added = [(t["content"], t["special"], t["lstrip"], t["rstrip"], t["single_word"], t["normalized"]) for t in own.get("added_tokens") or []]
    return (
        own.get("normalizer") is None
        and (splitter.get("type"), splitter.get("add_prefix_space"), splitter.get("use_regex", True)) == ("ByteLevel", False, True)
        and decoder.get("type") == "ByteLevel"
        and model.get("type", "BPE") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and all(x[0] == SPECIAL and x[1] and not any(x[2:5]) for x in added)
    )


def words_of(text: str, tokenizer) -> list[str]:
    """The words of a text in order; the special string is a word of its own."""
    if SPECIAL in text:
        out: list[str] = []
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                out.append(SPECIAL)
            out += words_of(part, tokenizer)
        return out
    if text.isascii() or not _OTHER.search(text):
        return _SPLIT.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def encode_words(words: list[str], tokenizer) -> list[bytes]:
    """Ids of each word, as little-endian unsigned 32-bit integers."""
    return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class Memo(dict):
    """Ids by word; a missing word is encoded and kept."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = encode_words([word], self.tokenizer)[0]
        return ids


_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
_SENT = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _ask(path: str, buckets: int, parts: int, width: int):
    """Distinct words of each block, packed by bucket."""

    def rows(block: int, words: set[str]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[str]] = {}
        for w in sorted(words):
            by.setdefault(crc32(w.encode("utf-8", "surrogatepass")) % buckets, []).append(w)
        for bucket, own in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([pack(pa.table({"word": own}))], pa.binary())], schema=_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, words, block = library(path), set(), None
        for of, part in blocks(batches, "block", parts, width):
            if words and (of != block or len(words) > HELD):
                yield from rows(block, words)
                words = set()
                release()
            block = of
            for text in texts(part.column("text")):
                words.update(words_of(text, tokenizer))
        if words:
            yield from rows(block, words)

    return run


def _answer(path: str):
    """Ids of the words that each block asked for; a bucket's words are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library(path)
        known: dict[str, bytes] = {}
        bucket = None
        for batch in batches:
            for of, block, blob in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), batch.column("blob"), strict=True):
                if of != bucket:
                    known, bucket = {}, of
                    release()
                words = unpack(blob.as_py()).column("word").to_pylist()
                new = [w for w in words if w not in known]
                known.update(zip(new, encode_words(new, tokenizer), strict=True))
                out = pack(pa.table({"word": words, "ids": pa.array([known[w] for w in words], pa.binary())}))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([out], pa.binary())], schema=_SENT)

    return run


def _packed_rows(part_column: str, parts: int, width: int):
    """A block's rows as a few compressed values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in blocks(batches, part_column, parts, width):
            blob = pack(part.drop_columns([part_column]))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())], schema=_SENT)

    return run


def _decoded(path: str):
    """Adds the joined pieces of the ids as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path) if plain(path) else None
        for batch in batches:
            release()
            for part in slices(batch, "ids"):
                own = part.column("ids")
                if table is None:
                    tokenizer = library(path)
                    text = [tokenizer.decode(list(memoryview(x.as_py() or b"").cast("I")), skip_special_tokens=False) for x in own]
                else:
                    sizes = np.asarray(pc.fill_null(pc.binary_length(own), 0), np.int64) // 4
                    ids = np.frombuffer(b"".join(x.as_py() or b"" for x in own), "<u4")
                    met = table.column("piece").take(pa.array(ids)).combine_chunks()  # the join: id k is row k
                    lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), met.cast(pa.large_binary()))
                    text = [x.as_py().decode("utf-8", "replace") for x in pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))]
                yield part.append_column("decoded", pa.array(text, pa.string()))

    return run


def _join(path: str, names: list[str]):
    """Joins the ids of a block to its words by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library(path)
        memo, at = Memo(tokenizer), None
        for batch in batches:
            for block, kind, blob in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if block != at:
                    memo, at = Memo(tokenizer), block
                    release()
                table = unpack(blob.as_py())
                if kind == 0:
                    memo.update(zip(table.column("word").to_pylist(), table.column("ids").to_pylist(), strict=True))
                    continue
                take = memo.__getitem__
                ids = [b"".join(map(take, words_of(t, tokenizer))) for t in texts(table.column("text"))]
                out = table.append_column("ids", pa.array(ids, pa.binary()))
                yield from out.select([*names, "ids"]).combine_chunks().to_batches()

    return run


def _whole(path: str, names: list[str]):
    """Ids of whole texts by the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library(path)
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.append_column("ids", pa.array(encode_words(texts(part.column("text")), tokenizer), pa.binary())).select([*names, "ids"])

    return run


def encode(docs: DataFrame, path: str, *keep: str, decoded: bool = False) -> DataFrame:
    """``keep`` columns of each row and ``ids``: binary, little-endian unsigned 32-bit integers.

    ``decoded`` adds what ``decode`` adds, in the worker that joins the ids: one
    process for a task, not two.
    """
    spark, buckets, width = docs.sparkSession, buckets_for(docs.sparkSession), shuffle_partitions(docs.sparkSession)
    path_there = ship(spark, path)
    keep = keep or ("doc_id",)
    own = aside(spread(docs).select(*dict.fromkeys([*keep, "text"])), "ids", "decoded")
    names = own.columns if "text" in keep else [c for c in own.columns if c != "text"]
    schema = own.select(*names).schema.add("ids", "binary")
    back = _decoded(path_there)
    if not plain(path):
        joined = _whole(path_there, names)
        met = own
    else:
        block = free(own.columns, "block")
        rows = own.withColumn(block, F.spark_partition_id())
        parts = rows.rdd.getNumPartitions()
        asked = rows.select("text", F.col(block).alias("block")).mapInArrow(_ask(path_there, buckets, parts, width), "bucket int, block int, blob binary")
        asked = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        answered = asked.mapInArrow(_answer(path_there), "block int, kind int, blob binary")
        packed = rows.mapInArrow(_packed_rows(block, parts, width), "block int, kind int, blob binary")
        met = answered.unionByName(packed).repartition(width, "block").sortWithinPartitions("block", "kind")
        joined = _join(path_there, names)
    if decoded:
        return met.mapInArrow(lambda batches: back(joined(batches)), schema.add("decoded", "string"))
    return met.mapInArrow(joined, schema)


@lru_cache(maxsize=4)
def piece_table(path: str) -> pa.Table:
    """The id-to-piece table: ``id``, without a gap from 0, and ``piece``, its bytes."""
    tokenizer = library(path)
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    # Byte-level BPE writes the 188 printable Latin-1 characters as themselves and the others from U+0100 on.
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain_bytes)]
    back = {chr(b): b for b in plain_bytes} | {chr(256 + i): b for i, b in enumerate(rest)}
    out = []
    for i in range(size):
        piece = tokenizer.id_to_token(i) or ""
        out.append(bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode())
    return pa.table({"id": pa.array(range(size), pa.uint32()), "piece": pa.array(out, pa.binary())})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the joined pieces of the ids as text."""
    own = aside(encoded, "decoded")
    return own.mapInArrow(_decoded(ship(own.sparkSession, path)), own.select("*", F.lit("").alias("decoded")).schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: count and digest of its ids, and digest of the text decoded from them."""
    done = encode(docs, path, "doc_id", decoded=True)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
