"""Benchmark decontamination by size-partitioned MinHash containment search.

The likeness of a short test item and a long document says little, so documents
are compared by windows that fit the item. Items are partitioned by the size of
their shingle set into classes up to 8, 16, 32, ... For each class of size u, a
document's shingles are cut into blocks of u / 2, and every three neighbouring
blocks are a window: any u shingles in a row lie within one. An item of the
class that is contained to 0.8 in a row has a likeness of at least 1/4 with that
window, so that with 64 coordinates it shares one but for one case in 10**7;
scattered over four places it still does but for one in 10**4. A shared
coordinate makes a candidate; candidates are verified by the exact containment of
the item's shingles in the set of the whole document. The bound doesn't hold for
items of up to FEW distinct shingles, as windows hold 12 at least: these are
candidates wherever a document has one of their shingles.

The items are searched for in blocks of bounded bytes (sets, coordinates and
objects), each broadcast once it has been measured; documents are not shuffled.
Where there are several blocks, the pairs of one are written and its broadcast is
given back before the next one is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, steps
from .textvec import U, Circulant, distinct, mix, shingles, slices, word_hashes

K = 64
FEW = 4
#: Bytes of items in a block, and of text that is taken apart at once.
BLOCK_BYTES, SLICE = 16 << 20, 512 << 10
#: Bytes between words: all but ASCII letters and digits, and parts of other characters.
APART = np.ones(256, bool)
AS_IS = np.arange(256, dtype=np.uint8)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def size_class(n: np.ndarray) -> np.ndarray:
    """The least power of two from 8 on that is at least ``n``."""
    return np.maximum(8, 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(pc.utf8_lower(column.cast(pa.large_string())), APART, AS_IS)


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(K)
        for batch in slices(batches, "text", SLICE):
            hashes, words = _words(batch.column("text"))
            values, count = distinct(*shingles(hashes, words, k))
            sig = circulant(values, count)
            ends = np.cumsum(count)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(np.minimum(words, k)), pa.array(count.astype(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([values[e - c : e].tobytes() for c, e in zip(count, ends, strict=True)], pa.binary())],
                names=["item_id", "words", "n", "sketch", "members"],
            )

    return run


class Index:
    """Items of one block: their sets and, for each size class, the coordinates of their sketches."""

    def __init__(self, rows: list, k: int, percent: int):
        self.k, self.percent = k, percent
        self.ids = [r.item_id for r in rows]
        self.words = np.array([r.words for r in rows], np.int64)
        self.members = [np.frombuffer(bytes(r.members), U) for r in rows]
        n = np.array([r.n for r in rows], np.int64)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        whole = np.flatnonzero(self.words == k)
        cls = size_class(n)
        few, many = whole[n[whole] <= FEW], whole[n[whole] > FEW]
        grams = np.concatenate([np.empty(0, U), *[self.members[i] for i in few]])
        order = np.argsort(grams, kind="stable")
        #: shingles of the items of few shingles, sorted, and their items
        self.few = grams[order], np.repeat(few, n[few])[order]
        for u in np.unique(cls[many]):
            of = many[cls[many] == u]
            keys = self.keys(np.stack([np.frombuffer(bytes(rows[i].sketch), np.uint32) for i in of])).ravel()
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], np.repeat(of, K)[order]
            seen = np.zeros(1 << 22, bool)
            seen[(keys >> U(42)).astype(np.int64)] = True
            self.classes[int(u)] = (keys, owner, seen)
        #: items of fewer words than a shingle: one shingle of their own length
        self.short = {int(w): np.flatnonzero(self.words == w) for w in np.unique(self.words) if 0 < w < k}

    @staticmethod
    def keys(sig: np.ndarray) -> np.ndarray:
        return mix(sig.astype(U) | (np.arange(K, dtype=U) << U(32)))

    def match(self, column: pa.Array, circulant: Circulant) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of every text and item whose containment reaches ``percent``."""
        hashes, words = _words(column)
        values, count = shingles(hashes, words, self.k)
        count = np.where(words >= self.k, count, 0)
        values = values[np.repeat(words >= self.k, np.where(words >= self.k, count, words > 0))]
        ends = np.cumsum(count)
        found: set[tuple[int, int]] = set()
        for u, (keys, owner, seen) in self.classes.items():
            half = u // 2
            blocks = -(-count // half)
            doc = np.repeat(np.arange(len(count)), blocks)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            sig = circulant(values, np.minimum(half, count[doc] - nth * half))
            window = sig.copy()
            for step in (1, 2):
                near = np.flatnonzero(nth + step < blocks[doc])
                window[near] = np.minimum(window[near], sig[near + step])
            first = np.flatnonzero((nth == 0) | (nth + 2 < blocks[doc]))
            asked = self.keys(window[first])
            row, _ = np.nonzero(seen[(asked >> U(42)).astype(np.int64)])
            asked = asked[seen[(asked >> U(42)).astype(np.int64)]]
            a, e = np.searchsorted(keys, asked), np.searchsorted(keys, asked, side="right")
            for r, x, y in zip(doc[first[row]][e > a].tolist(), a[e > a].tolist(), e[e > a].tolist(), strict=True):
                found.update((r, i) for i in owner[x:y].tolist())
        grams, owner = self.few
        if len(grams):
            a, e = np.searchsorted(grams, values), np.searchsorted(grams, values, side="right")
            hit = np.flatnonzero(e > a)
            rows = np.searchsorted(ends, hit, side="right")
            for r, x, y in zip(rows.tolist(), a[hit].tolist(), e[hit].tolist(), strict=True):
                found.update((r, i) for i in owner[x:y].tolist())
        out, held, was = [], np.empty(0, U), -1
        for r, i in sorted(found):
            if r != was:
                held, was = np.unique(values[ends[r] - count[r] : ends[r]]), r
            item = self.members[i]
            shared = int(np.count_nonzero(held[np.minimum(np.searchsorted(held, item), len(held) - 1)] == item))
            if 100 * shared >= self.percent * len(item):
                out.append((r, i, shared))
        for w, items in self.short.items():
            grams, n = shingles(hashes, words, w)
            own = np.array([self.members[i][0] for i in items])
            order = np.argsort(own, kind="stable")
            a, e = np.searchsorted(own[order], grams), np.searchsorted(own[order], grams, side="right")
            hit = np.flatnonzero((e > a) & (np.repeat(words, n) >= w))
            rows = np.repeat(np.arange(len(n)), n)
            out += [(r, int(items[order[j]]), 1) for r, j in sorted({(int(rows[h]), j) for h in hit for j in range(a[h], e[h])})]
        return out


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, k: int, percent: int, scratch: Scratch):
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    items = scratch.write(items.mapInArrow(_items(k), "item_id long, words long, n long, sketch binary, members binary").where("words > 0"), "items")
    size = items.agg(F.sum(F.octet_length("members") + 16 * K + 200)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "members"), F.lit(blocks)) == b).collect()
        yield scratch.spark.sparkContext.broadcast(Index(rows, k, percent)), blocks
    scratch.drop("items")


@steps("leaks")
def contained(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, percent: int = 80, scratch: Scratch) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): each row and item with at least ``percent`` of the item's shingles in the row's text.

    Words are runs of letters and digits in lower case. An item of fewer words than
    a shingle counts as one shingle of its own length. Items without words are
    contained in nothing.

    Null texts count as empty; null and repeated ids come back as they are, row
    by row. Empty tables give an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    out = None
    for index, blocks in _indexes(benchmark, item_col, item_text_col, shingle, percent, scratch):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x, circulant = index.value, Circulant(K)
            for batch in slices(batches, "text", SLICE):
                if hits := x.match(batch.column("text"), circulant):
                    r, i, shared = zip(*hits, strict=True)
                    n = [len(x.members[j]) for j in i]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(r)), pa.array([x.ids[j] for j in i], pa.int64()), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array([a / b for a, b in zip(shared, n, strict=True)])], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        part = rows.mapInArrow(run, schema)
        if blocks > 1:
            part = scratch.write(part, f"pairs{len(scratch.paths)}")
            index.destroy()
        out = part if out is None else out.union(part)
    return out


@steps("leaks")
def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, percent: int = 80, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns unchanged; cases as in ``contained``."""
    for index, _ in _indexes(benchmark, item_col, item_text_col, shingle, percent, scratch):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x, circulant = index.value, Circulant(K)
            for batch in slices(batches, text_col, SLICE):
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _, _ in x.match(batch.column(text_col), circulant)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
