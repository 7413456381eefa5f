"""A minimal perfect hash over 128-bit keys, with a fingerprint and a saturating count for each key.

Levels of bit arrays: a key that is alone at its place on a level is placed
there, the others go on to the next level; its index is the number of set bits
before it. The bits of all levels lie in 64-bit words, with the number of set bits
before each word, so that a key takes about 4 bits besides its fingerprint and
count. All steps work on whole arrays.
"""

from __future__ import annotations

import io

import numpy as np

from .textvec import MULS, U, mix

GAMMA = 1.7


class PerfectHash:
    """``fingerprints`` are low bits of the keys' second words; ``counts`` stay at the most that their type holds."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray):
        self.sizes, self.words, self.fingerprints, self.counts = sizes, words, fingerprints, counts
        ones = np.bitwise_count(words)
        self.before = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.uint32)

    @property
    def nbytes(self) -> int:
        """Bytes in memory."""
        return sum(x.nbytes for x in (self.sizes, self.words, self.before, self.fingerprints, self.counts))

    @staticmethod
    def place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        turn = U((int(MULS[level % 4]) * (level + 1)) & (2**64 - 1))
        return (mix(mix(first + turn) ^ (second * MULS[4] + turn)) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray, counts: np.ndarray, *, fingerprint: type = np.uint64, count: type = np.int64) -> PerfectHash:
        """The keys (first, second) are distinct."""
        levels, live = [np.zeros(0, bool)], np.arange(len(first))
        while len(live):
            size = int(GAMMA * len(live)) + 1
            at = cls.place(first[live], second[live], len(levels) - 1, size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            live = live[~alone[at]]
        bits = np.concatenate(levels)
        packed = np.packbits(np.append(bits, np.zeros(-len(bits) % 64, bool)), bitorder="little").view("<u8")
        made = cls(np.array([len(x) for x in levels[1:]], np.int64), packed, np.empty(len(first), fingerprint), np.empty(len(first), count))
        index = made.index(first, second)
        made.fingerprints[index] = second.astype(fingerprint)
        made.counts[index] = np.minimum(counts, np.iinfo(count).max)
        return made

    def index(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The place of each key; of a key that isn't in the set, any place or -1. One word may stand for all keys."""
        first, second = np.broadcast_arrays(first, second)
        out, live, base = np.full(len(first), -1, np.int64), np.arange(len(first)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(live):
                break
            at = base + self.place(first[live], second[live], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(U)
            hit = (word >> bit & U(1)).astype(bool)
            rank = self.before[at >> 6] + np.bitwise_count(word & ((U(1) << bit) - U(1)))
            out[live[hit]] = rank[hit]
            live = live[~hit]
            base += size
        return out

    def count_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The count of each key, 0 where the fingerprint says that it isn't in the set."""
        if not len(self.counts):
            return np.zeros(len(first), np.int64)
        at = self.index(first, second)
        safe = np.maximum(at, 0)
        return np.where((at >= 0) & (self.fingerprints[safe] == second.astype(self.fingerprints.dtype)), self.counts[safe], 0).astype(np.int64)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.sizes, words=self.words, fingerprints=self.fingerprints, counts=self.counts)
        return out.getvalue()

    @classmethod
    def loads(cls, blob: bytes) -> PerfectHash:
        z = np.load(io.BytesIO(blob))
        return cls(z["sizes"], z["words"], z["fingerprints"], z["counts"])
