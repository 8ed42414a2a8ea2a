"""Byte n-grams of a chunk of texts as integers, and fast per-gram scores.

A gram of ``order`` + 1 bytes is an integer whose lowest byte is the newest; its
suffixes are its low bytes.  Scores depend on the gram alone, so each is worked
out once and kept in a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from kvlume.llm.arrow import Words

MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(w: Words, order: int, pad: int, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all documents one after the other, and n + 1 offsets of the
    documents. Before a document stand ``pad`` bytes; ``end`` is added after it."""
    buf, off = w.buf, w.start[w.doc]
    n = len(off) - 1
    if end is not None:
        buf = np.insert(buf, off[1:], end)
        off = off + np.arange(n + 1)
    code = buf.astype(np.uint64)
    wide = code.copy()
    for k in range(1, order + 1):
        code[k:] |= wide[:-k] << np.uint64(8 * k)
    size = np.diff(off)
    for i in range(order):  # the first bytes of a document must not see the one before
        at = off[:-1][size > i] + i
        low = code[at] & np.uint64((1 << 8 * (i + 1)) - 1)
        for k in range(i + 1, order + 1):
            low |= np.uint64(pad << 8 * k)
        code[at] = low
    return code, off


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the rows between offsets, 0 where there are none."""
    n = len(off) - 1
    out = np.zeros((n, *values.shape[1:]))
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, off[some], axis=0, dtype=np.float64)
    return out


class Scores:
    """``of(grams)``: a row of scores for each gram, by a direct-mapped table in
    front of ``score``, which takes different grams in ascending order."""

    def __init__(self, score: Callable[[np.ndarray], np.ndarray], width: int, bits: int = 20):
        self.score, self.shift = score, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros((1 << bits, width), np.float32)

    def of(self, code: np.ndarray) -> np.ndarray:
        slot = ((code * MIX) >> self.shift).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != code)
        if not len(miss):
            return self.values[slot]
        new, back = np.unique(code[miss], return_inverse=True)
        got = self.score(new).astype(np.float32).reshape(len(new), -1)
        spot = ((new * MIX) >> self.shift).astype(np.int64)
        out = self.values[slot]
        out[miss] = got[back]
        self.keys[spot], self.values[spot] = new, got
        # of grams that share a slot the last one stays: make key and value agree
        lost = self.keys[spot] != new
        if lost.any():
            kept = np.searchsorted(new, self.keys[spot[lost]])
            self.values[spot[lost]] = got[kept]
        return out


class Counter:
    """Exact counts of grams in memory that does not grow with the text: a
    direct-mapped table, and from time to time partial counts that it hands out."""

    def __init__(self, bits: int = 20, hold: int = 400_000):
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
        self.counts = np.zeros(self.size, np.int64)
        self.hold, self.over = hold, []

    def add(self, code: np.ndarray):
        """Counts; yields partial counts where too many have no place."""
        slot = ((code * MIX) >> self.shift).astype(np.int64)
        free = np.flatnonzero(self.keys[slot] == np.iinfo(np.uint64).max)
        if len(free):
            self.keys[slot[free]] = code[free]  # one of each slot's grams wins
        hit = self.keys[slot] == code
        self.counts += np.bincount(slot[hit], minlength=self.size)
        rest = code[~hit]
        if len(rest):
            self.over.append(np.unique(rest, return_counts=True))
            if sum(len(k) for k, _ in self.over) > self.hold:
                yield self._merged()

    def _merged(self):
        key = np.concatenate([k for k, _ in self.over])
        n = np.concatenate([c for _, c in self.over])
        self.over = []
        key, back = np.unique(key, return_inverse=True)
        return key, np.bincount(back, n, len(key)).astype(np.int64)

    def rest(self):
        """All counts not handed out yet."""
        if self.over:
            yield self._merged()
        at = np.flatnonzero(self.counts)
        if len(at):
            yield self.keys[at], self.counts[at]
