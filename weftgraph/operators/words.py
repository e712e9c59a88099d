"""The most frequent or longest words of each row, without a shuffled row for each word.

A row has all words of its key, so its words are counted and cut where it is read.
Only rows whose key comes again are counted by a shuffle, one row for each of
their distinct words. A null text has no words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import lone_and_shared


@dataclass(frozen=True)
class Pick:
    """The first ``most`` words of a row, the most frequent or the longest ones first, ties by word."""

    most: int
    longest: bool = False
    #: Letters of a word, at least.
    least: int = 1
    stop: frozenset[str] = field(default_factory=frozenset)

    def takes(self, word: str) -> bool:
        return len(word) >= self.least and word not in self.stop

    def of(self, counts: Counter) -> list[str]:
        rank = (lambda w: (-len(w), w)) if self.longest else (lambda w: (-counts[w], w))
        return sorted(filter(self.takes, counts), key=rank)[: self.most]


def _counts(joined: str | None) -> Counter:
    return Counter(joined.split(" ")) if joined else Counter()


def top_words(rows: DataFrame, key: str, text: str, picks: Sequence[Pick], kind: Column | None = None) -> DataFrame:
    """``pick`` (its number), key, ``kind``, ``word``, ``place`` from 1; of a key's long words each is one for every kind that it has."""
    # Tokens have no spaces, so one string carries them.
    own = rows.select(key, (F.lit(None).cast("string") if kind is None else kind).alias("kind"), F.array_join(tokens(F.col(text)), " ").alias("words"))
    of = own.schema[key].dataType.simpleString()

    def best(batches):
        for batch in batches:
            at, pick, words, places = [], [], [], []
            for i, joined in enumerate(batch.column("words").to_pylist()):
                counts = _counts(joined)
                for p, each in enumerate(picks):
                    found = each.of(counts)
                    at += [i] * len(found)
                    pick += [p] * len(found)
                    words += found
                    places += range(1, len(found) + 1)
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pick, pa.int32()), batch.column(key).take(took), batch.column("kind").take(took), pa.array(words, pa.string()), pa.array(places, pa.int32())], names=["pick", key, "kind", "word", "place"])

    def counted(batches):
        for batch in batches:
            at, words, n = [], [], []
            for i, joined in enumerate(batch.column("words").to_pylist()):
                counts = _counts(joined)
                at += [i] * len(counts)
                words += counts
                n += counts.values()
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(took), batch.column("kind").take(took), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=[key, "kind", "word", "n"])

    lone, shared = lone_and_shared(own, key)
    out = lone.mapInArrow(best, f"pick int, {key} {of}, kind string, word string, place int")
    if shared is None:
        return out
    parts = shared.mapInArrow(counted, f"{key} {of}, kind string, word string, n bigint")
    for p, each in enumerate(picks):
        kept = parts.where((F.length("word") >= each.least) & ~F.col("word").isin(sorted(each.stop)))
        by = [key, "kind", "word"] if each.longest else [key, "word"]
        rank = F.length("word") if each.longest else F.col("n")
        sums = kept.groupBy(*by).agg(F.sum("n").alias("n"), *([] if each.longest else [F.min("kind").alias("kind")]))
        place = F.row_number().over(Window.partitionBy(key).orderBy(rank.desc(), "word", "kind"))
        out = out.unionByName(sums.withColumn("place", place).where(F.col("place") <= each.most).select(F.lit(p).alias("pick"), key, "kind", "word", "place"))
    return out
