"""Context-tree weighting over bytes: the arithmetic, with numpy only.

A *gram* is an unsigned 64-bit key holding ``depth`` context bytes, the most
recent first, and then the byte that followed them. Sorting grams therefore
puts every context of every length next to its extensions.

Each byte is eight binary decisions. A binary node (the bits of the byte seen
so far) has one context tree of its own; a tree node with counts (a, b) holds
the Krichevsky-Trofimov block probability ``Pe`` and the weighted probability

    Pw(s) = 1/2 Pe(s) + 1/2 prod Pw(children of s),      Pw = Pe at full depth.

After training the weight of "stop here" is fixed, lambda(s) = 1/2 Pe(s)/Pw(s),
and the probability of a bit is the mixture lambda*KT(s) + (1-lambda)*P(child).
A context that training never reached hands over to the estimate of its parent.
"""

from __future__ import annotations

import numpy as np

LN2 = np.log(2.0)
_SMALL = 1 << 14
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 1.0))])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _rising(n: np.ndarray, table: np.ndarray, start: float) -> np.ndarray:
    """log of start * (start+1) * ... * (start+n-1)."""
    out = table[np.minimum(n, _SMALL)]
    large = n > _SMALL
    if large.any():
        x = n[large].astype(np.float64) + start
        at = np.float64(_SMALL + start)
        out[large] = table[_SMALL] + _stirling(x) - _stirling(at)
    return out


def log_pe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _rising(a, _HALF, 0.5) + _rising(b, _HALF, 0.5) - _rising(a + b, _WHOLE, 1.0)


def grams_of(data: np.ndarray, depth: int) -> np.ndarray:
    """Keys of all positions from ``depth`` (7 at most) on of a byte array."""
    n = len(data) - depth
    # Eight bytes read at each position, little end first: the context's latest byte has the highest weight.
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((n,), "<u8", padded, strides=(1,))
    key = wide & np.uint64((1 << (8 * depth)) - 1)
    key <<= np.uint64(8)
    key |= data[depth:]
    return key


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


class Level:
    """All nodes of one context length: per (context, byte) and bit, sorted."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        self.symbols = symbols  # context bytes << 8 | byte, sorted and distinct
        self.counts = counts
        self.keys: list[np.ndarray] = []
        self.zeros: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        context = symbols & ~np.uint64(0xFF)
        byte = symbols & np.uint64(0xFF)
        for bit in range(8):
            node = context | (byte >> np.uint64(8 - bit))
            at = _runs(node)
            one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            total = np.add.reduceat(counts, at) if len(at) else counts[:0]
            ones = np.add.reduceat(np.where(one, counts, 0), at) if len(at) else counts[:0]
            self.keys.append(node[at])
            self.ones.append(ones)
            self.zeros.append(total - ones)

    def parent_keys(self, bit: int) -> np.ndarray:
        """The same node one context byte shorter (the oldest byte goes)."""
        key = self.keys[bit]
        return ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(0xFF))


def levels(grams: np.ndarray, counts: np.ndarray, depth: int, least: int) -> dict[int, Level]:
    """Levels from ``depth`` down to ``least`` of sorted distinct grams."""
    out = {depth: Level(grams, counts)}
    for d in range(depth - 1, least - 1, -1):
        upper = out[d + 1]
        short = ((upper.symbols >> np.uint64(16)) << np.uint64(8)) | (upper.symbols & np.uint64(0xFF))
        order = np.argsort(short, kind="stable")
        short, many = short[order], upper.counts[order]
        at = _runs(short)
        out[d] = Level(short[at], np.add.reduceat(many, at) if len(at) else many)
    return out


def weigh(tree: dict[int, Level]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Per level and bit: (log Pw, lambda), from the deepest level up."""
    deepest = max(tree)
    out: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for d in sorted(tree, reverse=True):
        out[d] = []
        for bit in range(8):
            level = tree[d]
            pe = log_pe(level.zeros[bit], level.ones[bit])
            if d == deepest:
                out[d].append((pe, np.ones(len(pe))))
                continue
            below = tree[d + 1]
            at = np.searchsorted(level.keys[bit], below.parent_keys(bit))
            kids = np.bincount(at, weights=out[d + 1][bit][0], minlength=len(pe))
            pw = np.logaddexp(pe, kids) - LN2
            out[d].append((pw, np.exp(pe - LN2 - pw)))
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log2_probability(grams: np.ndarray, depth: int, tree: dict[int, Level], weights) -> np.ndarray:
    """log2 of the mixture's probability of each gram's byte after its context.

    ``tree`` and ``weights`` must hold every level from 0 to ``depth``.
    """
    total = np.zeros(len(grams))
    byte = grams & np.uint64(0xFF)
    for bit in range(8):
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        p = np.full(len(grams), 0.5)
        known = np.zeros(len(grams), bool)
        for d in range(depth, -1, -1):
            level = tree[d]
            context = (grams >> np.uint64(8 * (depth + 1 - d))) << np.uint64(8) if d else np.zeros(len(grams), np.uint64)
            at, seen = find(level.keys[bit], context | (byte >> np.uint64(8 - bit)))
            if not len(level.keys[bit]):
                continue
            a, b = level.zeros[bit][at], level.ones[bit][at]
            kt = (np.where(one, b, a) + 0.5) / (a + b + 1.0)
            lam = np.where(known, weights[d][bit][1][at], 1.0)
            p = np.where(seen, lam * kt + (1 - lam) * p, p)
            known |= seen
        total += np.log2(p)
    return total
