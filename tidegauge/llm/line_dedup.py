"""Removal of lines that many documents share.

A sharded minimal perfect hash over all distinct line hashes indexes compact
fingerprint and saturating count arrays, and documents probe the arrays: a line
whose count reaches the threshold goes. Shards are built where the counts of their
lines meet. Each keeps its arrays over all lines, and the same over those alone
that its counts show to reach the threshold.

Where the arrays over all lines stay under a byte bound, measured as they lie in
memory, they are broadcast; else those over the lines that reach it, which decide
alike. Either way the documents are read once, without any shuffle of text. Where
those don't fit either, documents are cut into batches, whose distinct line hashes
are routed to the shards, and only decisions return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Batches, dealt
from .perfect_hash import PerfectHash
from .scratch import Scratch, steps
from .textvec import LOWER, MULS, SPACE, U, flat, mix, slices, span_hash

#: Bytes of text whose lines a shard has on average, of arrays that are broadcast, and of text in a routed batch.
SHARD_BYTES, BROADCAST_BYTES, BATCH_BYTES = 32 << 20, 48 << 20, 16 << 20


class Lines:
    """The lines of a batch of texts: byte places, keys' hashes, and which have a key of at least ``least`` code points."""

    def __init__(self, column: pa.Array, least: int):
        self.buf, self.offs = buf, offs = flat(column)
        n = int(offs[-1])
        breaks = np.flatnonzero(buf[:n] == 10)
        per = np.searchsorted(breaks, offs)
        self.count = np.diff(per) + 1
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        firsts = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        self.first = np.zeros(len(self.doc), bool)
        self.first[firsts] = True
        self.start, self.end = np.empty(len(self.doc), np.int64), np.empty(len(self.doc), np.int64)
        self.start[firsts], self.start[~self.first] = offs[:-1], breaks + 1
        last = np.roll(self.first, -1)
        self.end[last], self.end[~last] = offs[1:], breaks
        solid = np.flatnonzero(~SPACE[buf[:n]])
        lo, hi = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        some = np.flatnonzero(hi > lo)
        a, b = solid[lo[some]], solid[hi[some] - 1] + 1
        if least > 1:
            chars = np.concatenate([[0], np.cumsum((buf[:n] & 0xC0) != 0x80)])
            long = chars[b] - chars[a] >= least
            some, a, b = some[long], a[long], b[long]
        self.some = some
        folded = LOWER[buf]
        self.h1 = span_hash(folded, a, b)
        # a second, independent hash: of the key with its bytes replaced
        self.h2 = mix(span_hash(folded ^ np.uint8(0x5A), a, b) * MULS[3])

    def without(self, drop: np.ndarray) -> pa.Array:
        """The texts without the lines marked in ``drop``."""
        keep = ~drop
        firsts = np.flatnonzero(self.first)
        kept = np.cumsum(keep)
        before = kept - keep - np.repeat((kept - keep)[firsts], self.count)
        sizes = np.empty(2 * len(keep), np.int64)
        flags = np.empty(2 * len(keep), bool)
        sizes[0::2], sizes[1::2] = ~self.first, self.end - self.start
        flags[0::2], flags[1::2] = keep & (before > 0), keep
        mask = np.repeat(flags, sizes)
        data = self.buf[: len(mask)][mask]
        size = np.add.reduceat((sizes * flags)[0::2] + (sizes * flags)[1::2], firsts) if len(firsts) else np.empty(0, np.int64)
        offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


def _merged(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted by their first word, and the sums of ``n``."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
    return a[at], b[at], np.add.reduceat(n, at) if len(at) else n


def _cut(a: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards of sorted first words, and their borders."""
    shard = _shard(a, bits)
    border = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(a) else np.empty(0, np.int64)
    return shard[border], np.append(border, len(a))


def _tally(least: int, bits: int):
    """Rows (shard, keys, counts): the keys of a stretch of documents, counted once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = Lines(batch.column("text"), least)
            doc = x.doc[x.some]
            order = np.lexsort((x.h2, x.h1, doc))
            d, a, b = doc[order], x.h1[order], x.h2[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, n = _merged(a[new], b[new], np.ones(int(new.sum()), np.int64))
            shard, border = _cut(a, bits)
            spans = list(zip(border, border[1:], strict=False))
            keys = np.stack([a, b], 1)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array([keys[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([n[s:e].astype(np.int32).tobytes() for s, e in spans], pa.binary())], names=["shard", "keys", "counts"])

    return run


def _keys(column) -> np.ndarray:
    return np.concatenate([np.empty((0, 2), U), *[np.frombuffer(x.as_buffer(), U).reshape(-1, 2) for x in column]])


def _build(min_docs: int):
    """The arrays of a shard: over all its lines, with fingerprints of 16 bits (those that are asked for are in the set), and over those that reach the threshold, with 64 bits (others are asked for too)."""
    kind = np.uint8 if min_docs < 1 << 8 else np.uint16 if min_docs < 1 << 16 else np.int64

    def run(table: pa.Table) -> pa.Table:
        keys = _keys(table.column("keys"))
        a, b, n = _merged(keys[:, 0], keys[:, 1], np.concatenate([np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in table.column("counts")]))
        whole = PerfectHash.build(a, b, n, fingerprint=np.uint16, count=kind)
        often = whole.counts[whole.index(a, b)] >= min_docs
        common = PerfectHash.build(a[often], b[often], n[often], count=kind)
        return pa.table({"shard": table.column("shard")[:1], "whole_bytes": pa.array([whole.nbytes], pa.int64()), "common_bytes": pa.array([common.nbytes], pa.int64()), "whole": pa.array([whole.dumps()], pa.binary()), "common": pa.array([common.dumps()], pa.binary())})

    return run


def _shard(h1: np.ndarray, bits: int) -> np.ndarray:
    return (h1 >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h1), np.int64)


def _rewrite(schema: T.StructType, least: int, text: str, decide):
    """Rows with the text and the two counts replaced; ``decide(batch, lines)`` marks the keyed lines to drop."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            x = Lines(batch.column(text), least)
            drop = np.zeros(len(x.doc), bool)
            drop[x.some] = decide(batch, x)
            firsts = np.flatnonzero(x.first)
            new = {text: x.without(drop), "n_lines": pa.array(x.count.astype(np.int64)), "n_dropped": pa.array(np.add.reduceat(drop, firsts, dtype=np.int64))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c) if c in batch.schema.names else None) for c in names], names=names)

    return run


@steps("lines")
def drop_common_lines(docs: DataFrame, *, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES, batch_bytes: int = BATCH_BYTES, scratch: Scratch) -> DataFrame:
    """``docs`` with the text of each row without its common lines, and the columns ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without ASCII white space at both ends, A-Z lowered.
    Keys of at least ``min_chars`` code points that occur in at least ``min_docs``
    rows lose all their lines everywhere; the others stay, joined by newlines.

    Null and empty texts have one empty line and come back as empty text. Every
    row counts as a document of its own, repeated ids included. Input columns
    called n_lines or n_dropped are replaced; all others pass unchanged, whatever
    their names. An empty table gives an empty result. Lines are compared by 128 bits
    of hash.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    total = text.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(0, (total // SHARD_BYTES).bit_length())
    counted = text.mapInArrow(_tally(min_chars, bits), "shard long, keys binary, counts binary")
    index = scratch.write(counted.groupBy("shard").applyInArrow(_build(min_docs), "shard long, whole_bytes long, common_bytes long, whole binary, common binary"), "index")
    whole, common = index.agg(F.sum("whole_bytes"), F.sum("common_bytes")).first()
    arrays = "whole" if (whole or 0) <= broadcast_bytes else "common"
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    if (whole or 0) <= broadcast_bytes or (common or 0) <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in index.select("shard", arrays).collect()})
        scratch.close()
        opened: dict[int, PerfectHash] = {}

        def decide(_, x: Lines) -> np.ndarray:
            return _probe(opened, held.value.get, x.h1, x.h2, bits) >= min_docs

        return docs.mapInArrow(_rewrite(schema, min_chars, text_col, decide), schema)
    return _routed(docs, text_col, min_docs, min_chars, index, bits, schema, batch_bytes, scratch)


def _probe(opened: dict, fetch, h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    shard, out = _shard(h1, bits), np.zeros(len(h1), np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            s = int(shard[part[0]])
            if s not in opened:
                blob = fetch(s)
                opened[s] = PerfectHash.loads(blob) if blob else None
            if opened[s]:
                out[part] = opened[s].count_of(h1[part], h2[part])
    return out


def _routed(docs, text_col, min_docs, min_chars, index, bits, schema, batch_bytes, scratch):
    """The way beyond the broadcast bound: the shards decide, for batches of documents."""
    held = Batches(scratch, "batches")
    files = dealt(scratch.write(held.write(docs, text_col, batch_bytes), "files"))

    def ask(table: pa.Table) -> pa.Table:
        shards, keys = [], []
        got = held.read(table)
        parts = [Lines(batch.column(text_col), min_chars) for batch in slices(iter(got.to_batches()), text_col)]
        a, b, _ = _merged(*(np.concatenate([np.empty(0, U), *[getattr(x, h) for x in parts]]) for h in ("h1", "h2")), np.ones(sum(len(x.h1) for x in parts), np.int64))
        shards, border = _cut(a, bits)
        keys = np.stack([a, b], 1)
        return pa.table({"shard": pa.array(shards), "b": pa.array([table.column("b")[0].as_py()] * len(shards), pa.int64()), "keys": pa.array([keys[s:e].tobytes() for s, e in zip(border, border[1:], strict=False)], pa.binary())})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows:
            arrays = PerfectHash.loads(right.column("whole")[0].as_py())
            for blob in left.column("keys"):
                h = np.frombuffer(blob.as_buffer(), U).reshape(-1, 2)
                found.append(h[arrays.count_of(h[:, 0], h[:, 1]) >= min_docs].tobytes())
        return pa.table({"b": left.column("b"), "keys": pa.array(found, pa.binary())})

    def drop(table: pa.Table, replies: pa.Table) -> pa.Table:
        common = _keys(replies.column("keys"))
        order = np.lexsort((common[:, 1], common[:, 0]))
        common = common[order]

        def decide(_, x: Lines) -> np.ndarray:
            if not len(common):
                return np.zeros(len(x.h1), bool)
            # first words of two lines may be equal: look at the second words of the whole run
            at, end = np.searchsorted(common[:, 0], x.h1), np.searchsorted(common[:, 0], x.h1, side="right")
            out = np.zeros(len(x.h1), bool)
            while (more := np.flatnonzero(at < end)).size:
                out[more] |= common[at[more], 1] == x.h2[more]
                at[more] += 1
            return out

        return pa.Table.from_batches(list(_rewrite(schema, min_chars, text_col, decide)(iter(held.read(table).to_batches()))))

    asked = files.applyInArrow(ask, "shard long, b long, keys binary")
    replies = scratch.write(asked.groupBy("shard").cogroup(index.select("shard", "whole").groupBy("shard")).applyInArrow(answer, "b long, keys binary"), "replies")
    result = scratch.write(files.cogroup(replies.groupBy("b")).applyInArrow(drop, schema), "result")
    scratch.close("result")
    return result
