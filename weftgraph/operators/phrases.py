"""Key phrases by association: word sequences that come together more often than their parts would by chance.

Two passes. The first counts sequences of two to ``longest`` words over the
whole corpus, and scores each (words but the last, last word) by the
log-likelihood ratio of the two parts. The second looks up each text's own
sequences and keeps the best.

A sequence is a phrase if it occurs ``least`` times, scores ``threshold`` or
more, its parts come together more often than by chance, and its first and last
words are neither stop words nor shorter than three letters. Sequences are counted
by slices of text where these are read; only those that begin with such a word,
and of the longest ones those that end with one too, are shuffled. What parts
have besides is counted by word: how often it ends a sequence of each size.

Most texts have their best phrases among the ``MOST_BROADCAST`` best of all:
these are looked up where the texts are read. The others' sequences meet all
phrases by a shuffle.

Null and empty texts have no phrases; repeated rows count each time; an empty
table has none; other columns are kept, but for names of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import QUERY_STOPWORDS, tokens
from ..storage import MOST_BROADCAST, lone_and_shared, stored
from .joins import hot_join

#: The ratio that chance exceeds once in a thousand cases (chi-squared, one degree of freedom).
THRESHOLD = 10.83
LEAST = 3
LONGEST = 3
#: Bytes of words whose sequences are counted at a time.
SLICE_BYTES = 8 << 20


def _joined(text: str) -> Column:
    # Tokens have no spaces, so one string carries them.
    return F.array_join(tokens(F.coalesce(F.col(text), F.lit(""))), " ").alias("words")


def _slices(batches) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``SLICE_BYTES`` of words, a row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64))
        starts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(ends)]
        for a, b in pairwise(starts):
            if b > a:
                yield batch.slice(a, b - a)


class _Sequences:
    """Word sequences of joined words by place, numbered by what they are."""

    def __init__(self, joined: pa.Array):
        some = np.flatnonzero(pc.binary_length(joined).to_numpy(zero_copy_only=False))
        listed = pc.split_pattern(joined.take(pa.array(some)), " ")
        encoded = pc.list_flatten(listed).dictionary_encode()
        self.names, self.ids = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = some[pc.list_parent_indices(listed).to_numpy(zero_copy_only=False)]
        ends = np.cumsum(np.bincount(self.row, minlength=len(joined)))
        place = np.arange(len(self.ids))
        #: Words from a place to the end of its row, itself included, and words before it.
        self.left = ends[self.row] - place
        self.before = place - np.concatenate([[0], ends[:-1]])[self.row]
        stop = pc.is_in(self.names, value_set=pa.array(QUERY_STOPWORDS, pa.string()))
        long = pc.greater_equal(pc.utf8_length(self.names), 3)
        self.content = pc.and_(long, pc.invert(stop)).to_numpy(zero_copy_only=False).astype(bool)[self.ids]

    def of_sizes(self, longest: int, ends: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
        """For each size from 1: places where sequences begin with a content word, their numbers, and what these are. The longest end with one, too; with ``ends`` only such are given."""
        first = np.flatnonzero(self.content)
        used, numbers = np.unique(self.ids[first], return_inverse=True)
        names = self.names.take(pa.array(used))
        for size in range(1, longest + 1):
            if size > 1:
                own = self.left[first] >= size
                if size == longest:
                    own &= self.content[np.minimum(first + size - 1, len(self.ids) - 1)]
                first, numbers = first[own], numbers[own]
                of, numbers = np.unique(numbers * len(self.names) + self.ids[first + size - 1], return_inverse=True)
                head, last = (pa.array(x) for x in np.divmod(of, max(1, len(self.names))))
                names = pc.binary_join_element_wise(names.take(head), self.names.take(last), " ")
            if ends and size < longest:
                own = self.content[first + size - 1]
                yield size, first[own], numbers[own], names
            else:
                yield size, first, numbers, names


def _counted(longest: int):
    """Counts by slice: sequences (``kind`` is their size) with ``n`` and how many words follow; last words of sequences (minus their size); all sequences of a size (0)."""

    def rows(kind: int, seq: pa.Array, n: np.ndarray, followed: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(n), kind, np.int32)), seq, pa.array(n.astype(np.int64)), pa.array(followed.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "seq", "n", "followed"])

    def run(batches):
        for batch in _slices(batches):
            s = _Sequences(batch.column("words"))
            for size, first, numbers, names in s.of_sizes(longest):
                follows = numbers[s.left[first] > size]
                yield rows(size, names, np.bincount(numbers, minlength=len(names)), np.bincount(follows, minlength=len(names)))
            sizes = range(2, longest + 1)
            for size in sizes:
                n = np.bincount(s.ids[s.content & (s.before >= size - 1)], minlength=len(s.names))
                some = np.flatnonzero(n)
                yield rows(-size, s.names.take(pa.array(some)), n[some], np.zeros(len(some)))
            totals = np.array([np.count_nonzero(s.before >= size - 1) for size in sizes])
            yield rows(0, pa.array([str(size) for size in sizes], pa.string()), totals, totals)

    return run


def _content(word: Column) -> Column:
    return (F.length(word) >= 3) & ~word.isin(QUERY_STOPWORDS)


def likely(both: Column, head: Column, last: Column, total: Column) -> Column:
    """Log-likelihood ratio of a two by two table: how often both parts, the head, the last word, and anything at all occur."""
    cells = [(both, head, last), (head - both, head, total - last), (last - both, total - head, last), (total - head - last + both, total - head, total - last)]
    terms = [F.when(n > 0, n * F.log(n * total.cast("double") / (row.cast("double") * col))).otherwise(0.0) for n, row, col in cells]
    return 2 * (terms[0] + terms[1] + terms[2] + terms[3])


def phrases(texts: DataFrame, text: str = "text", least: int = LEAST, threshold: float = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """``phrase``, ``size``, ``n`` and ``association`` of all phrases of a table of texts."""
    parts = texts.select(_joined(text)).mapInArrow(_counted(longest), "kind int, seq string, n bigint, followed bigint")
    sums = parts.groupBy("kind", "seq").agg(F.sum("n").alias("n"), F.sum("followed").alias("followed"))
    # A part of a candidate occurs as often as that, or more.
    counts = stored(sums.where((F.col("kind") == 0) | (F.col("n") >= least)), "sequences")
    totals = F.broadcast(counts.where("kind = 0").select(F.col("seq").cast("int").alias("size"), F.col("n").alias("total")))  # a row for each size
    last = F.substring_index("seq", " ", -1)
    candidates = counts.where((F.col("kind") >= 2) & _content(last)).select(F.col("kind").alias("size"), F.col("seq").alias("phrase"), "n")

    def key(size: Column, part: Column) -> Column:
        return F.concat_ws(" ", size.cast("string"), part).alias("key")

    def joined(rows: DataFrame, marginal: DataFrame, name: str) -> DataFrame:
        many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        return hot_join(rows, stored(marginal.join(many, "key"), name), "key", "rows").drop("key")

    heads = counts.where((F.col("kind") >= 1) & (F.col("followed") >= least)).select(key(F.col("kind") + 1, F.col("seq")), F.col("followed").alias("of_head"))
    lasts = counts.where("kind < 0").select(key(-F.col("kind"), F.col("seq")), F.col("n").alias("of_last"))
    # The head is the phrase without its last word.
    head = F.expr("substring_index(phrase, ' ', size - 1)")
    with_head = joined(candidates.withColumn("key", key(F.col("size"), head)), heads, "head_counts")
    rows = stored(with_head.withColumn("key", key(F.col("size"), F.substring_index("phrase", " ", -1))), "by_last")
    met = joined(rows, lasts, "last_counts").join(totals, "size")
    n, head, last, total = (F.col(c) for c in ("n", "of_head", "of_last", "total"))
    together = n.cast("double") * total > head.cast("double") * last
    scored = met.withColumn("association", F.round(likely(n, head, last, total), 6)).where(together & (F.col("association") >= threshold))
    return scored.select("phrase", "size", "n", "association")


def _best(known: DataFrame, most: int) -> tuple[pa.Table, bool]:
    """The phrases of the highest association, best first, about ``most`` of them: all above a bound; and whether these are all."""
    n = known.count()
    whole = n <= most
    if not whole:
        bound = known.approxQuantile("association", [1 - 0.8 * most / n], 0.2 * most / n)[0]
        known = known.where(F.col("association") > bound)
    table = known.select("phrase", "association").distinct().toArrow().combine_chunks()  # bounded by ``most``
    return table.sort_by([("association", "descending"), ("phrase", "ascending")]), whole


def key_phrases(texts: DataFrame, known: DataFrame, key: str, text: str = "text", most: int = 12, longest: int = LONGEST) -> DataFrame:
    """The ``most`` phrases of each row with the highest association: (key, phrase, association, place).

    Ties go to the phrase that is less. Rows of one key are one. A row that has ``most`` of
    the best phrases of all has no better ones; sequences of other rows, and of rows
    whose key comes again, meet the phrases by a shuffle.
    """
    known = stored(known.select("phrase", "association", "n"), "phrases")
    table, whole = _best(known, MOST_BROADCAST)
    own = texts.select(key, _joined(text))
    of = own.schema[key].dataType.simpleString()
    best = texts.sparkSession.sparkContext.broadcast((table.column("phrase").combine_chunks(), table.column("association").combine_chunks()))

    def looked_up(batches):
        phrase, association = best.value
        for batch in _slices(batches):
            s = _Sequences(batch.column("words"))
            pairs = []
            for size, first, numbers, names in s.of_sizes(longest, ends=True):
                if size > 1:
                    rank = pc.fill_null(pc.index_in(names, value_set=phrase), -1).to_numpy(zero_copy_only=False).astype(np.int64)[numbers]
                    pairs.append((s.row[first] * (len(phrase) + 1) + rank)[rank >= 0])
            at, rank = np.divmod(np.unique(np.concatenate([np.zeros(0, np.int64), *pairs])), len(phrase) + 1)
            n = np.bincount(at, minlength=batch.num_rows)
            place = np.arange(len(at)) - (np.cumsum(n) - n)[at]
            done = np.full(batch.num_rows, True) if whole else n >= most
            own = done[at] & (place < most)
            left = np.flatnonzero(~done)
            took, of_rest = pa.array(rank[own]), pa.array(left)
            keys = batch.column(key)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at[own])), phrase.take(took), association.take(took), pa.array((place[own] + 1).astype(np.int32)), pa.nulls(len(took), pa.string())], names=names_out)
            if len(left):
                yield pa.RecordBatch.from_arrays([keys.take(of_rest), pa.nulls(len(left), pa.string()), pa.nulls(len(left), pa.float64()), pa.nulls(len(left), pa.int32()), batch.column("words").take(of_rest)], names=names_out)

    def listed(batches):
        for batch in _slices(batches):
            s = _Sequences(batch.column("words"))
            for size, first, numbers, names in s.of_sizes(longest, ends=True):
                if size > 1:
                    at, number = np.divmod(np.unique(s.row[first] * max(1, len(names)) + numbers), max(1, len(names)))
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), names.take(pa.array(number))], names=[key, "phrase"])

    names_out = [key, "phrase", "association", "place", "words"]
    lone, rest = lone_and_shared(own, key)
    found = stored(lone.mapInArrow(looked_up, f"{key} {of}, phrase string, association double, place int, words string"), "best_phrases")
    settled = found.where("phrase is not null").select(key, "phrase", "association", "place")
    if not whole:
        left = found.where("phrase is null").select(key, "words")
        rest = left if rest is None else left.unionByName(rest)
    if rest is None:
        return settled
    met = hot_join(stored(rest.mapInArrow(listed, f"{key} {of}, phrase string"), "own_sequences"), known, "phrase")
    first = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("association")).alias("low"), "phrase"))), 1, most)
    rows = met.groupBy(key).agg(first.alias("best")).select(key, F.posexplode("best").alias("place", "b"))
    return settled.unionByName(rows.select(key, "b.phrase", (-F.col("b.low")).alias("association"), (F.col("place") + 1).alias("place")))
