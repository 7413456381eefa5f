"""Vectorised text kernels on Arrow string buffers: words, shingles, MinHash.

All functions work on the UTF-8 bytes of a whole batch at once, so no Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
MULS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(at, to - at)
            at, base = to, int(size[to - 1])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, with 8 zero bytes behind, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    buf = np.zeros(len(raw) + 8, np.uint8)
    buf[: len(raw)] = raw
    return buf, offs - offs[0]


def words_at(buf: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word that starts at every byte (a view)."""
    return np.ndarray(shape=(max(len(buf) - 7, 0),), dtype="<u8", buffer=buf, strides=(1,))


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross documents: starts, ends and the number for each document."""
    n = int(offs[-1])
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    m = member[:n]
    first, last = m.copy(), m.copy()
    first[1:] &= ~(m[:-1] & ~edge[1:n])
    last[:-1] &= ~(m[1:] & ~edge[1:n])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, offs))


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    at, size = words_at(buf), end - start
    h = mix(size.astype(U) * MULS[0] + U(1))
    live, done = np.arange(len(start)), 0
    while len(live):
        left = size[live] - done
        v = at[start[live] + done] & MASKS[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ (v * MULS[1]))
        done += 8
        live = live[left > 8]
    return h


def word_hashes(column: pa.Array, sep: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text."""
    buf, offs = flat(column)
    n = int(offs[-1])
    start, end, count = runs(~sep[buf[:n]], offs)
    return span_hash(fold[buf], start, end), count


def shingles(hashes: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in order, and their number for each text; of fewer words, the sequence as one."""
    ends = np.cumsum(count)
    rem = np.repeat(ends, count) - np.arange(len(hashes))
    first = np.repeat(count, count) == rem
    at = np.flatnonzero((rem >= k) | first)
    rem = rem[at]
    h = np.minimum(rem, k).astype(U) * MULS[4]
    padded = np.concatenate([hashes, np.zeros(k, U)])
    for j in range(k):
        h += np.where(rem > j, padded[at + j], U(0)) * (MULS[j % 4] + U(2 * j))
    return mix(h), np.where(count > 0, np.maximum(count - k + 1, 1), 0)


def distinct(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    ends = np.cumsum(count)
    parts = [np.unique(values[e - c : e]) for c, e in zip(count, ends, strict=True)]
    return np.concatenate(parts) if parts else values[:0], np.array([len(p) for p in parts], dtype=np.int64)


class Circulant:
    """Circulant MinHash: an initial permutation (the mixed hash), then one permutation of the 32-bit ring, which coordinate k sees shifted by k places.

    The second permutation is a chain of odd multiplications and xor-shifts, each
    a bijection of the ring; ``pi(v + k)`` for k = 1..K is all that differs
    between coordinates.
    """

    def __init__(self, k: int, block: int = 32768):
        self.k, self.block = k, block

    def __call__(self, values: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The coordinates of each non-empty set, as rows of 32-bit words; empty sets have the highest word throughout."""
        out = np.full((len(count), self.k), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(count)
        if not len(full):
            return out
        v = (values ^ (values >> U(32))).astype(np.uint32)
        ends = np.cumsum(count[full])
        begin, at = 0, 0
        while at < len(full):
            to = max(at + 1, int(np.searchsorted(ends, begin + self.block, side="right")))
            part, offs = v[begin : ends[to - 1]] * np.uint32(0x9E3779B1), np.concatenate([[0], ends[at : to - 1] - begin]).astype(np.intp)
            y, z = np.empty_like(part), np.empty_like(part)
            rows = full[at:to]
            for k in range(self.k):
                np.add(part, np.uint32(((k + 1) * 0x9E3779B1) & 0xFFFFFFFF), out=y)
                np.right_shift(y, 16, out=z)
                np.bitwise_xor(y, z, out=y)
                np.multiply(y, np.uint32(0x85EBCA6B), out=y)
                np.right_shift(y, 13, out=z)
                np.bitwise_xor(y, z, out=y)
                np.multiply(y, np.uint32(0xC2B2AE35), out=y)
                out[rows, k] = np.minimum.reduceat(y, offs)
            begin, at = int(ends[to - 1]), to
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
