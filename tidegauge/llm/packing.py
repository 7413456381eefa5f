"""Best-fit-decreasing packing of tokenised documents into sequences of fixed length.

Lengths are integers up to the sequence length, so all pieces of one length are
alike: the packer works on the histogram of lengths, which has at most
``capacity`` rows whatever the corpus, and places runs of equal pieces into runs
of equal bins. A segment tree over remaining capacities finds the tightest open
capacity that fits in logarithmic time. The runs are what plain best-fit
decreasing does document by document. Pieces then look up their place by their
rank among the pieces of their length, which is counted in parallel.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, steps

PIECES_A_BUCKET = 20_000


class Capacities:
    """A segment tree over capacities 0..capacity; a node says whether any bin below it is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.groups: list[deque[tuple[int, int]]] = [deque() for _ in range(self.size)]

    def add(self, remaining: int, first: int, many: int) -> None:
        if many:
            self.groups[remaining].append((first, many))
            self._count(remaining, 1)

    def _count(self, remaining: int, by: int) -> None:
        i = remaining + self.size
        while i:
            self.open[i] += by
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open bin."""
        i = least + self.size
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, remaining: int, many: int) -> tuple[int, int]:
        """Up to ``many`` bins of one run with this capacity: the first and their number."""
        first, n = self.groups[remaining].popleft()
        if n > many:
            self.groups[remaining].appendleft((first + many, n - many))
            return first, many
        self._count(remaining, -1)
        return first, n


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first bin, pieces a bin, offset) in order of length and rank, and the number of bins."""
    tree, runs, bins = Capacities(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            each = (capacity if room is None else room) // length
            if room is None:
                room, first, many = capacity, bins, -(-left // each)
                bins += many
            else:
                first, many = tree.take(room, -(-left // each))
            placed = min(left, many * each)
            runs.append((length, rank, first, each, capacity - room))
            whole, rest = divmod(placed, each)
            tree.add(room - each * length, first, whole)
            if rest:
                tree.add(room - rest * length, first + whole, 1)
            left, rank = left - placed, rank + placed
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), bins


@cache
def encoder(json_path: str, ranks_path: str | None):
    """A function from texts to lists of ids, those of ``tokenizers`` for the vocabulary at ``json_path``.

    ``ranks_path`` names the same vocabulary in the form of ``tiktoken``, several
    times faster; tests hold both against each other. Texts that spell a special
    token go to ``tokenizers`` in any case.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    encode_slow = lambda texts: [e.ids for e in slow.encode_batch_fast(texts, add_special_tokens=False)]
    if not ranks_path:
        return encode_slow
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [encode_slow([t])[0] if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

    return encode


def _pieces(json_path: str, ranks_path: str | None, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keys, out = batch.column("doc_id").to_pylist(), []
                for key, ids in zip(keys, encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                    a = np.array([*ids, end_id], dtype="<u4")
                    cuts = [0, *range(len(a) % capacity or capacity, len(a) + 1, capacity)]
                    out += [(key, i, s, e - s, zlib.crc32(a[s:e].tobytes()), a[s:e].astype(np.int32) if with_ids else None) for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
                cols = list(zip(*out, strict=True)) or [()] * 6
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:5], names=names if with_ids else names[:5])

    return run


@steps("pack")
def pack(docs: DataFrame, *, json_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False, scratch: Scratch) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A document is its token ids and ``end_id``. Only documents of more than
    ``capacity`` tokens are cut, from the end, so that the first piece may be
    shorter. Sequences hold pieces without gaps from offset 0; their number is
    that of best-fit decreasing over all pieces.

    Null text counts as empty: one piece that is ``end_id`` alone. Null and
    repeated ids are packed row by row. An empty table gives an empty result.
    Other columns are not read. The vocabulary files are named by path and have
    to be readable on every executor.
    """
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pieces(json_path, ranks_path, capacity, end_id, with_ids), schema)
    pieces = scratch.write(pieces, "pieces")
    buckets = max(1, pieces.count() // PIECES_A_BUCKET)
    ranked = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    ranked = scratch.write(ranked.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1), "ranked")
    counts = scratch.write(ranked.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = best_fit(histogram, capacity)
    plan = spark.sparkContext.broadcast(runs)  # its size depends on the capacity, not on the corpus
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    placed = ranked.join(before.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "bucket")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        shift = np.int64(1) << np.int64(48)
        keys = rows[:, 0] * shift + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = rows[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            i = rank - run[:, 1]
            arrays = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(run[:, 2] + i // run[:, 3]), pa.array(run[:, 4] + i % run[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    result = scratch.write(placed.mapInArrow(place, f"{schema}, sequence_id long, offset long"), "result")
    scratch.close("result")
    return result
