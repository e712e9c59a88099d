"""Token counts through a digest cache.

A cache table holds (content digest, tokenizer version digest) -> count. A run
joins the digests of its texts to it, encodes each distinct text that is
missing once, appends those counts to the cache and joins all counts back.

The content is the whole text, null as empty; nothing else is normalised, as a
count must be that of the text itself. Appending twice is harmless: a key that
occurs more than once has the same count each time and is read once.

Null ids and rows that share an id are counted each by its own text; an empty
table gives an empty result and appends nothing; other columns, whatever their
names, are not read. A content that many rows have (more than a thousandth) is
joined by a broadcast, so its rows don't meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import library, plain, words_of
from .common import FEW, HOT_SHARE, hot_join, local, scratch, ship, slices, stored, texts

CACHE = "content binary, version string, n_tokens long"
#: Distinct words whose counts a task remembers; beyond that it starts anew.
REMEMBERED = 500_000


def version_of(path: str) -> str:
    """Digest of the vocabulary file and of how it is applied."""
    with open(path, "rb") as f:
        return sha256(f.read() + b"|plain-1").hexdigest()


class Counts(dict):
    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return n


def _json_counter(path: str):
    tokenizer = library(path)
    if not plain(path):
        return lambda many: [len(x.ids) for x in tokenizer.encode_batch_fast(many, add_special_tokens=False)]
    counts = Counts(tokenizer)

    def count(many: list[str]) -> list[int]:
        if len(counts) > REMEMBERED:
            counts.clear()
        return [sum(map(counts.__getitem__, words_of(t, tokenizer))) for t in many]

    return count


def counter(path: str):
    """A function from texts to token counts: tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=local(path))
        return lambda many: [len(x) for x in processor.encode(many, num_threads=1)]
    return _json_counter(path)


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """The cache table; a folder that is not there yet is an empty cache."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def count_tokens(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row; new counts are appended to ``cache``."""
    spark, version = docs.sparkSession, version_of(path)
    shipped = ship(spark, path)
    text = F.coalesce("text", F.lit(""))
    keyed = stored(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content")), "digests")
    # One row of each content: narrow rows only, copies meet before the shuffle.
    contents = stored(keyed.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "contents")
    known = cached(spark, cache).where(F.col("version") == version).select("content").distinct()
    misses = contents.join(known, "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = counter(shipped), set()
        for batch in batches:
            for part in slices(batch, "text"):
                # Rows that share id and content come together or lie in one file: encoded once a slice and not again in the next.
                found = {sha256(t.encode("utf-8", "surrogatepass")).digest(): t for t in texts(part.column("text"))}
                found, last = {c: t for c, t in found.items() if c not in last}, set(found)
                many, content = list(found.values()), pa.array(list(found), pa.binary())
                yield pa.RecordBatch.from_arrays([content, pa.array([version] * len(many), pa.string()), pa.array(count(many), pa.int64())], names=["content", "version", "n_tokens"])

    # Texts go by id and digest to the side that holds the chosen rows; a hot content is found by a broadcast, where its rows lie.
    wanted = misses.select(F.col("doc_id").alias("of"), F.col("content").alias("wanted"), "n")
    total = contents.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    source = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"))
    same = (F.col("content") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("of"))
    if total <= FEW:
        chosen = source.join(wanted.hint("shuffle_hash"), same, "left_semi").select("text")
    else:
        found = source.join(F.broadcast(wanted.where(hot)), same, "left_semi")
        cold = source.join(F.broadcast(contents.where(hot).select("content")), "content", "left_anti")
        chosen = found.unionByName(cold.join(wanted.where(~hot).hint("shuffle_hash"), same, "left_semi")).select("text")
    chosen.mapInArrow(encode, CACHE).write.mode("append").option("compression", "zstd").parquet(cache)
    counts = cached(spark, cache).where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    lookup = stored(contents.select("content", "n").join(counts, "content"), "counts")
    return hot_join(keyed, lookup, "content").select("doc_id", "n_bytes", "n_tokens")


def counted(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Counts all rows with a cache of this run's own, and says whether a text is over the limit.

    The table comes in two loads, by a hash of the id: the second finds
    the first one's counts in the cache, as a later load of a corpus would.
    """
    cache = scratch(docs.sparkSession, "token_cache")
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    loads = [count_tokens(docs.where(load), path, cache) for load in (early, ~early)]
    return loads[0].unionByName(loads[1]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
