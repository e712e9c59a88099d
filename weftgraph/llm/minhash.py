"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch of ``t`` coordinates is filled in rounds. In each of the first t rounds
every shingle of a set is hashed anew, to a bin and a value, and the least value
of an empty bin stays there; a set is done when no bin is empty. In round t + i
all its shingles go to bin i, so after 2t rounds every coordinate is filled,
whatever the set's size; large sets are done after one or two rounds. Two sets
agree in a coordinate with the probability of their similarity, and the number of
agreeing coordinates is concentrated about its mean at least as well as that of t
independent minimum hashes. All sets of a batch go through the rounds together.

``BANDS`` bands of ``BAND_ROWS`` coordinates make the keys of a set. Sets that
share a key are candidates, and every link is confirmed on the full sets. Two
sets of exactly the least similarity s share no key with probability
(1 - s ** rows) ** bands, for the defaults and 0.8 about 5e-8, and less above it;
below it keys get rare fast (0.23 at a similarity of 0.3).

Keys, links and components go through ``jaccard_join.link_components``: sets of
one digest are one class, hubs stand for long lists, hot keys, members and
components are split, and remaining pairs of lists are compared, so no
candidate is dropped or capped. Nothing is collected.

Null or wordless text has an empty set and links with nothing; null ids count
least as names, repeated rows are copies of each other, of rows that share an id
each has its own links. Sets too small to link with any other but an equal one
make no keys. An empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard_join import _A, _mixed, join

#: Two sets link from PERCENT per cent of their union on; shingles have WORDS words. Defaults, those of op13.
PERCENT, WORDS = 80, 2
#: Bands of a sketch, and coordinates of a band.
BANDS, BAND_ROWS = 32, 4


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The sketch of each set of 64-bit hashes as a row of t values; an empty set's row is all ones."""
    out = np.full(len(sets) * t, ~np.uint64(0))
    filled = np.zeros(len(out), bool)
    values = np.concatenate([np.zeros(0, np.uint64), *sets])
    first = np.repeat(np.arange(len(sets)) * t, [len(s) for s in sets])  # of each value, the place of its set's row
    seeds = np.arange(1, 2 * t + 1, dtype=np.uint64) * _A[3]
    for i in range(2 * t):
        if not len(values):
            break
        h = _mixed(values + seeds[i])
        at = first + (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else first + (i - t)
        if i:
            empty = ~filled[at]
            at, h = at[empty], h[empty]
        np.minimum.at(out, at, h)
        filled[at] = True
        left = ~filled.reshape(-1, t).all(axis=1)[first // t]
        values, first = values[left], first[left]
    return out.reshape(-1, t)


class Bands:
    """Keys of sets by the bands of their sketches."""

    def __init__(self, percent: int = PERCENT, bands: int = BANDS, rows: int = BAND_ROWS):
        self.percent, self.bands, self.rows = percent, bands, rows

    def each(self, sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        keyed = [len(s) > 0 and 100 * len(s) // self.percent > len(s) for s in sets]
        made = sketches([s for s, own in zip(sets, keyed, strict=True) if own], self.bands * self.rows).reshape(-1, self.bands, self.rows)
        keys = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), made.shape[:2])
        for i in range(self.rows):
            keys = _mixed(keys * _A[0] + made[:, :, i])
        every, none = iter(keys.view(np.int64)), np.zeros(0, np.int64)
        return [(next(every), np.zeros(self.bands, np.int32)) if own else (none, np.zeros(0, np.int32)) for own in keyed]


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` (the row's id names its component) of every row."""
    found = join(docs, percent, words, Bands(percent, bands, rows))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
