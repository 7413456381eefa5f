"""Removal of byte strings that a document with a smaller id has too.

A string of ``width`` bytes goes if it also starts in a document with a smaller
id. Not every suffix has to be sorted for that: every window of ``width`` bytes
is filed under its anchor, the place of the least hash of a GRAM-byte gram
within it, and equal windows have equal anchors. Four rounds over the documents,
in batches of bounded bytes:

1. batches send the hashes of their anchors to shards, which answer which of
   them occur in several documents;
2. for those, batches send a hash of the context (all bytes of the windows of
   the anchor) and the least id that has it. A document with a larger id than
   the least one of its context loses all windows of the context;
3. where an anchor has several contexts, the batch with the least id of each
   sends its bytes. The shard sorts their suffixes by bucket-pointer refinement
   (``refine``). A bucket at depth ``width`` is one distinct window; its least id
   is the answer;
4. batches mark and remove what a smaller id has.

A batch is a stretch of the input, written once as a compressed file in the shared
folder and read by its name in each round, so that texts are never shuffled. What
a batch sends is aggregated: a passage in a third of all documents costs a shard
one context a batch. Batches and shards grow with the square root of the corpus,
so that a batch still has some hundreds of hashes for each shard.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Batches, dealt
from .scratch import Scratch, steps
from .textvec import MASKS, MULS, U, flat, mix, span_hash, words_at

GRAM = 20
BATCH_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
WAVE = 1 << 18
LAST = np.iinfo(np.int64).max


def _sliding(x: np.ndarray, width: int, fold) -> np.ndarray:
    """``fold`` (minimum or maximum) over every window of ``width`` places."""
    have = 1
    y = x
    while have * 2 <= width:
        y = fold(y[:-have], y[have:])
        have *= 2
    rest = width - have
    return fold(y[:-rest], y[rest:]) if rest else y


class Anchors:
    """Anchors of all windows of ``width`` bytes of the texts in ``buf``: their place, hash and document."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, width: int):
        self.buf, self.offs, self.width = buf, offs, width
        n, self.span = int(offs[-1]), width - GRAM + 1
        self.at = np.empty(0, np.int64)
        self.low = np.empty(0, np.uint32)
        if n >= width:
            u = words_at(buf)
            m = n - GRAM + 1
            t = u[:m] * MULS[0]
            t += u[8 : m + 8] * MULS[1]
            t += u[GRAM - 8 : m + GRAM - 8] * MULS[2]
            t ^= t >> U(32)
            t *= MULS[3]
            x = np.maximum((t >> U(32)).astype(np.uint32), 1)
            low = _sliding(x, self.span, np.minimum)
            ends, starts = offs[1:], offs[:-1]
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, np.maximum(starts, ends - width + 1), 1)
            np.add.at(edge, ends, -1)
            low[np.cumsum(edge)[: len(low)] > 0] = 0
            pad = np.zeros(self.span - 1, np.uint32)
            high = _sliding(np.concatenate([pad, low, pad]), self.span, np.maximum)
            self.at = np.flatnonzero(x == high)
            self.low, self.x = low, x
        self.doc = np.searchsorted(offs, self.at, side="right") - 1
        u = words_at(buf)
        self.hash = mix(mix(u[self.at] * MULS[1]) + mix(u[self.at + 8] * MULS[2]) * U(3) + mix(u[self.at + GRAM - 8] * MULS[4]) * U(7)) if len(self.at) else np.empty(0, U)

    def contexts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the anchors ``which``: the first of their windows, the number of windows, and a hash of all their bytes."""
        at = self.at[which]
        first, many = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        padded = np.concatenate([np.zeros(self.span - 1, np.uint32), self.low, np.zeros(self.span, np.uint32)])
        for s in range(0, len(at), 100_000):
            part = at[s : s + 100_000]
            hit = padded[part[:, None] + np.arange(self.span)] == self.x[part][:, None]
            first[s : s + 100_000] = part - (self.span - 1) + hit.argmax(1)
            many[s : s + 100_000] = hit.sum(1)
        code = mix(span_hash(self.buf, first, first + many + self.width - 1) + (at - first).astype(U) * MULS[0])
        return first, many, code


def refine(text: np.ndarray, starts: np.ndarray, width: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """Bucket pointers of the suffixes at ``starts`` to a depth of ``width`` bytes: equal if and only if the bytes are.

    ``text`` holds strings of ``sizes`` bytes in a row (one string by default) and 8
    bytes more. A suffix ends with its string; one of ``starts`` has at least
    ``width`` bytes.

    All suffixes are sorted into buckets of equal 8-byte grams. The pointer of a
    suffix is the last place of its bucket in the suffix array, so that a bucket
    splits without a change elsewhere. Buckets with several of ``starts`` are refined
    one stretch of the array after the other: a bucket that is sorted to depth h is
    sorted by the pointers h bytes further on, which adds the depth of the buckets
    that they name; its parts go on at once, recursively, until they are ``width``
    deep. Later stretches meet the pointers that earlier ones have updated, and so
    gain more than 8 bytes at a step. Pointers that tell apart what only differs
    beyond ``width`` bytes give way to the first ones, of 8 bytes.
    """
    n = len(text) - 8
    ends = np.cumsum([n] if sizes is None else sizes)
    end = np.repeat(ends, np.diff(ends, prepend=0)).astype(np.int32)
    left = np.minimum(end - np.arange(n, dtype=np.int32), 8)
    gram = words_at(text)[:n] & MASKS[left]
    short = np.flatnonzero(left < 8)
    whole = np.flatnonzero(left == 8)
    order = np.concatenate([whole[np.argsort(gram[whole], kind="stable")], short[np.lexsort((gram[short], left[short]))]]).astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = (gram[order][1:] != gram[order][:-1]) | (left[order][1:] != left[order][:-1])
    del gram, left, short, whole
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    pointer = np.empty(n, np.int32)
    pointer[order] = np.repeat(last, last - first + 1)
    grams = pointer.copy()
    depth = np.full(n, 8, np.int16)  # of the bucket that ends at a place
    live = np.add.reduceat(wanted[order], first, dtype=np.int64) > 1 if n else np.empty(0, bool)
    first, last = first[live], last[live]
    stretch = np.cumsum(last - first + 1) // WAVE
    for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(stretch)) + 1):
        lo, hi, h = first[part], last[part], depth[last[part]].astype(np.int64)
        while len(lo):
            count = hi - lo + 1
            place, of = _spread(lo, count), np.repeat(np.arange(len(lo)), count)
            at = order[place]
            far = at + h[of]
            key = np.where(far < end[at], pointer[np.minimum(far, n - 1)], -1).astype(np.int64)
            gain = np.where(key < 0, 1, depth[key])
            over = h + np.maximum.reduceat(gain, np.cumsum(count) - count) > width
            if over.any():
                step = np.minimum(h, width - 8)
                near = at + step[of]
                key = np.where(over[of], np.where(near < end[at], grams[np.minimum(near, n - 1)], -1), key)
                gain = np.where(over[of], step[of] + 8 - h[of], gain)
            by = np.argsort(of * np.int64(n + 1) + key, kind="stable")
            key, at, gain = key[by], at[by], gain[by]
            cut = np.ones(len(by), bool)
            cut[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            head = np.flatnonzero(cut)
            tail = np.append(head[1:], len(by)) - 1
            order[place] = at
            pointer[at] = np.repeat(place[tail], tail - head + 1)
            deep = np.where(key[head] < 0, width, h[of[head]] + gain[head])
            depth[place[tail]] = deep
            on = (np.add.reduceat(wanted[at], head, dtype=np.int64) > 1) & (deep < width)
            lo, hi, h = place[head][on], place[tail][on], deep[on]
    return pointer[starts].astype(np.int64)


def _key(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(h * MULS[1] + c)


def _cut(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards of sorted hashes: their numbers and the borders."""
    shard = (h >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    border = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(h) else np.empty(0, np.int64)
    return shard[border], np.append(border, len(h))


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", 3)


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and ids of a batch; a missing id is the largest, and is marked."""
    column = table.column("text").combine_chunks()
    buf, offs = flat(column if isinstance(column, pa.Array) else column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary()))
    ids = table.column("doc_id")
    return buf, offs, ids.fill_null(LAST).to_numpy(), ids.is_null().to_numpy()


def _ask_hashes(width: int, bits: int, held: Batches):
    def run(table: pa.Table) -> pa.Table:
        buf, offs, ids, absent = _texts(held.read(table))
        x = Anchors(buf, offs, width)
        use = ~absent[x.doc]
        h, d = x.hash[use], ids[x.doc[use]]
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        many = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(h) else np.empty(0, bool)
        h = h[at]
        shard, border = _cut(h, bits)
        spans = list(zip(border, border[1:], strict=False))
        b = table.column("b")[0].as_py()
        return pa.table({"shard": pa.array(shard), "b": pa.array([b] * len(shard), pa.int64()), "hashes": pa.array([h[s:e].tobytes() for s, e in spans], pa.binary()), "many": pa.array([many[s:e].tobytes() for s, e in spans], pa.binary())})

    return run


def _repeated(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x.as_buffer(), U) for x in table.column("hashes")]
    h = np.concatenate(parts)
    many = np.concatenate([np.frombuffer(x.as_buffer(), bool) for x in table.column("many")])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    group = np.cumsum(new) - 1
    hot = (np.bincount(group) > 1) | (np.bincount(group, weights=many[order]) > 0)
    keep = np.empty(len(h), bool)
    keep[order] = hot[group]
    ends = np.cumsum([len(p) for p in parts])
    blobs = [p[keep[e - len(p) : e]].tobytes() for p, e in zip(parts, ends, strict=True)]
    return pa.table({"b": table.column("b"), "hashes": pa.array(blobs, pa.binary())})


def _known(table: pa.Table, column: str, dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *[np.frombuffer(x.as_buffer(), dtype) for x in table.column(column) if x.is_valid]])


CLASS = np.dtype([("h", "<u8"), ("c", "<u8"), ("lo", "<i8")])
LEAST = np.dtype([("h", "<u8"), ("key", "<u8"), ("least", "<i8")])
WANT = np.dtype([("h", "<u8"), ("key", "<u8")])
CONTEXT = np.dtype([("h", "<u8"), ("key", "<u8"), ("least", "<i8"), ("many", "<i4"), ("size", "<i4")])
ANSWER = np.dtype([("h", "<u8"), ("key", "<u8"), ("from", "<i4"), ("many", "<i4"), ("least", "<i8")])


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``known`` ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``count`` places of each, in a row."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])) if len(columns[0]) else np.empty(0, np.int64)


def _blank(**kinds: pa.DataType) -> pa.Table:
    return pa.table({k: pa.array([], t) for k, t in kinds.items()})


def _ask_classes(width: int, bits: int, held: Batches):
    """What a batch knows of each context of a repeated anchor: a hash of it, and the least id that has it."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        known = np.sort(_known(replies, "hashes", U))
        if not table.num_rows or not len(known):
            return _blank(shard=pa.int64(), b=pa.int64(), rows=pa.binary())
        buf, offs, ids, absent = _texts(held.read(table))
        x = Anchors(buf, offs, width)
        which = np.flatnonzero(_within(x.hash, known) & ~absent[x.doc])
        code = x.contexts(which)[2]
        h, d = x.hash[which], ids[x.doc[which]]
        order = np.lexsort((code, h))
        h, code, d = h[order], code[order], d[order]
        new = _first(h, code)
        rows = np.empty(len(new), CLASS)
        rows["h"], rows["c"] = h[new], code[new]
        if len(new):
            rows["lo"] = np.minimum.reduceat(d, new)
        shard, border = _cut(rows["h"], bits)
        return pa.table({"shard": pa.array(shard), "b": pa.array([table.column("b")[0].as_py()] * len(shard), pa.int64()), "rows": pa.array([rows[s:e].tobytes() for s, e in zip(border, border[1:], strict=False)], pa.binary())})

    return run


def _classes(table: pa.Table) -> pa.Table:
    """For each batch: the least id of each of its contexts where another batch has it, and which contexts it is to send.

    Bytes are needed only where one anchor has several contexts, and of each
    context from the batch with the least id (several, if rows repeat that id).
    """
    parts = [np.frombuffer(x.as_buffer(), CLASS) for x in table.column("rows")]
    rows = np.concatenate(parts)
    order = np.lexsort((rows["lo"], rows["c"], rows["h"]))
    s = rows[order]
    new = _first(s["h"], s["c"])
    kind = np.empty(len(rows), np.int64)
    kind[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(rows))))
    least, h = s["lo"][new], s["h"][new]
    mixed = np.zeros(len(new), bool)
    mixed[1:] |= h[1:] == h[:-1]
    mixed[:-1] |= h[1:] == h[:-1]
    ends, lows, wants = np.cumsum([len(p) for p in parts]), [], []
    for p, e in zip(parts, ends, strict=True):
        mine = kind[e - len(p) : e]
        key = _key(p["h"], p["c"])
        beaten = least[mine] < p["lo"]
        low = np.empty(int(beaten.sum()), LEAST)
        low["h"], low["key"], low["least"] = p["h"][beaten], key[beaten], least[mine][beaten]
        send = ~beaten & mixed[mine]
        want = np.empty(int(send.sum()), WANT)
        want["h"], want["key"] = p["h"][send], key[send]
        lows.append(low.tobytes())
        wants.append(want.tobytes())
    return pa.table({"b": table.column("b"), "lows": pa.array(lows, pa.binary()), "wants": pa.array(wants, pa.binary())})


def _ask_contexts(width: int, bits: int, held: Batches):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        wants = _known(replies, "wants", WANT)
        if not table.num_rows or not len(wants):
            return _blank(shard=pa.int64(), b=pa.int64(), rows=pa.binary(), bytes=pa.binary())
        buf, offs, ids, absent = _texts(held.read(table))
        x = Anchors(buf, offs, width)
        which = np.flatnonzero(_within(x.hash, np.unique(wants["h"])) & ~absent[x.doc])
        first, many, code = x.contexts(which)
        key = _key(x.hash[which], code)
        use = _within(key, np.sort(wants["key"]))
        h, key, first, many, d = x.hash[which][use], key[use], first[use], many[use], ids[x.doc[which]][use]
        order = np.lexsort((d, key, h))
        h, key, first, many, d = h[order], key[order], first[order], many[order], d[order]
        new = _first(h, key)
        rows = np.empty(len(new), CONTEXT)
        rows["h"], rows["key"], rows["least"], rows["many"], rows["size"] = h[new], key[new], d[new], many[new], many[new] + width - 1
        first = first[new]
        shard, border = _cut(rows["h"], bits)
        blobs, texts = [], []
        for s, e in zip(border, border[1:], strict=False):
            blobs.append(rows[s:e].tobytes())
            texts.append(_zstd().compress(buf[_spread(first[s:e], rows["size"][s:e].astype(np.int64))].tobytes(), asbytes=True))
        return pa.table({"shard": pa.array(shard), "b": pa.array([table.column("b")[0].as_py()] * len(shard), pa.int64()), "rows": pa.array(blobs, pa.binary()), "bytes": pa.array(texts, pa.binary())})

    return run


def _answer(width: int):
    """For each context, the runs of windows that a smaller id has within another context."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), CONTEXT) for x in table.column("rows")]
        rows = np.concatenate(parts)
        text = np.concatenate([*[np.frombuffer(_zstd().decompress(x.as_buffer(), int(p["size"].sum())), np.uint8) for x, p in zip(table.column("bytes"), parts, strict=True)], np.zeros(8, np.uint8)])
        place = np.cumsum(rows["size"].astype(np.int64)) - rows["size"]
        many = rows["many"].astype(np.int64)
        starts, owner = _spread(place, many), np.repeat(np.arange(len(rows)), many)
        bucket = refine(text, starts, width, rows["size"].astype(np.int64))
        low = np.full(int(bucket.max()) + 1, LAST)
        np.minimum.at(low, bucket, rows["least"][owner])
        value, window = low[bucket], starts - place[owner]
        edge = _first(owner, value)
        length = np.diff(np.append(edge, len(owner)))
        use = value[edge] < rows["least"][owner[edge]]
        edge, length = edge[use], length[use]
        runs = np.empty(len(edge), ANSWER)
        runs["h"], runs["key"], runs["from"], runs["many"], runs["least"] = rows["h"][owner[edge]], rows["key"][owner[edge]], window[edge], length, value[edge]
        ends = np.cumsum([len(p) for p in parts])
        border = np.searchsorted(owner[edge], np.concatenate([[0], ends]))
        return pa.table({"b": table.column("b"), "answers": pa.array([runs[s:e].tobytes() for s, e in zip(border, border[1:], strict=False)], pa.binary())})

    return run


def _matched(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``table`` with each key: their indices, and the places of the keys."""
    order = np.argsort(table["key"], kind="stable")
    found = table["key"][order]
    a, e = np.searchsorted(found, keys), np.searchsorted(found, keys, side="right")
    return order[_spread(a, e - a)], np.repeat(np.arange(len(keys)), e - a)


def _remove(width: int, with_kept: bool, held: Batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = held.read(table)
        buf, offs, ids, absent = _texts(table)
        n = int(offs[-1])
        gone = np.zeros(n + 1, np.int64)
        lows, answers = _known(replies, "lows", LEAST), _known(replies, "answers", ANSWER)
        x = Anchors(buf, offs, width)
        order = np.argsort(x.hash, kind="stable")
        h, d = x.hash[order], ids[x.doc[order]]
        at = _first(h)
        several = h[at][np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)] if len(at) else h
        which = np.flatnonzero(_within(x.hash, np.unique(np.concatenate([lows["h"], answers["h"], several]))) & ~absent[x.doc])
        if len(which):
            first, many, code = x.contexts(which)
            key, own = _key(x.hash[which], code), ids[x.doc[which]]
            kinds, kind = np.unique(key, return_inverse=True)
            least = np.full(len(kinds), LAST)
            np.minimum.at(least, kind, own)
            i, at = _matched(kinds, lows)
            np.minimum.at(least, at, lows["least"][i])
            whole = least[kind] < own
            np.add.at(gone, first[whole], 1)
            np.add.at(gone, first[whole] + many[whole] + width - 1, -1)
            i, at = _matched(key, answers)
            hit = answers["least"][i] < own[at]
            i, at = i[hit], at[hit]
            start = first[at] + answers["from"][i]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + answers["many"][i] + width - 1, -1)
        removed = np.cumsum(gone)[:n] > 0
        change = removed.copy()
        if n:
            change[1:] &= ~removed[:-1]
            inner = offs[(offs > 0) & (offs < n)]
            change[inner] = removed[inner]
        total, spans = np.concatenate([[0], np.cumsum(removed)]), np.concatenate([[0], np.cumsum(change)])
        kept = [buf[s:e][~removed[s:e]].tobytes() for s, e in zip(offs, offs[1:], strict=False)]
        cols = [table.column("doc_id"), np.diff(offs), np.diff(total[offs]), np.diff(spans[offs]), [hashlib.sha256(k).hexdigest() for k in kept], *[kept] * with_kept]
        return pa.table({k: c if isinstance(c, pa.ChunkedArray) else pa.array(c) for k, c in zip(names, cols, strict=True)})

    return run


@steps("suffix")
def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, with_kept: bool = False, batch_bytes: int | None = None, scratch: Scratch) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]), one row for each row of ``docs``.

    Texts are UTF-8 bytes. Each byte goes that is covered by a ``width``-byte
    string (at least GRAM + 8) which also starts in a document with a smaller id;
    overlaps count, strings are judged on the input, and never cross documents.

    Null text counts as empty. A row with a null id loses nothing and takes
    nothing from others. Rows that repeat an id, with equal or different texts, don't
    take from each other. Texts shorter than ``width`` bytes stay; a text longer than
    ``batch_bytes`` is a batch of its own. An empty table gives an empty result.
    Other columns are not read, so they may have any name.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    grown = math.isqrt(1024 * total)
    bits = max(0, (-(-total // max(SHARD_BYTES, grown))).bit_length())
    held = Batches(scratch, "batches")
    files = dealt(scratch.write(held.write(docs, "text", batch_bytes or max(BATCH_BYTES, grown)), "files"))
    asked = files.applyInArrow(_ask_hashes(width, bits, held), "shard long, b long, hashes binary, many binary")
    hot = scratch.write(asked.groupBy("shard").applyInArrow(_repeated, "b long, hashes binary"), "repeated")
    asked = files.cogroup(hot.groupBy("b")).applyInArrow(_ask_classes(width, bits, held), "shard long, b long, rows binary")
    classes = scratch.write(asked.groupBy("shard").applyInArrow(_classes, "b long, lows binary, wants binary"), "classes")
    scratch.drop("repeated")
    asked = files.cogroup(classes.select("b", "wants").groupBy("b")).applyInArrow(_ask_contexts(width, bits, held), "shard long, b long, rows binary, bytes binary")
    answers = scratch.write(asked.groupBy("shard").applyInArrow(_answer(width), "b long, answers binary"), "answers")
    none = F.lit(None).cast("binary")
    replies = classes.select("b", "lows", none.alias("answers")).union(answers.select("b", none, "answers"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    result = scratch.write(files.cogroup(replies.groupBy("b")).applyInArrow(_remove(width, with_kept, held), schema), "result")
    scratch.close("result")
    return result
