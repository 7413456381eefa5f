"""Quality selection by importance resampling.

Two generative models over hashed n-grams, one of a target (documents labelled
good) and one of the raw text (all documents), give each document an importance:
the ratio of its probabilities under the two. A sample without replacement by
that weight is the top k of log weight plus standard Gumbel noise; k is a share
of the documents, by default that of the good ones among the labelled.

Where the models differ from maximum likelihood, and why (figures in the README):

* an n-gram counts once a document, so that one long document or a run of
  repeats moves a count by one;
* log ratios of either sign are shrunken smoothly towards 0, by how sure the
  counts are and by how large the ratio is. The raw counts of rare n-grams add up
  to a noise of hundreds in a long text, which buries the evidence;
* labelled bad documents are evidence too: the good ones are set against all
  labelled ones as well as against the raw text, and the stronger ratio counts;
* every n-gram has two buckets in independent tables, of which the ratio nearer to
  0 counts (none, if their signs differ), so that chance collisions move nothing;
* a labelled document is judged by the counts without itself, so that it is
  treated like one without a label.

The labelled rows that are used are bounded by ``most_labels``; the raw model,
the scores and the selection cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, steps
from .textvec import LOWER, MULS, SPACE, U, distinct, flat, mix, slices, span_hash

BUCKETS, CHUNK, SALTS = 1 << 20, 1 << 15, 256
#: Bytes of text that are taken apart at once; a worker's arrays take some fifty times that.
SLICE = 512 << 10
#: Documents that a bucket is taken to have seen beforehand; the surprise at which a ratio is halved, against the raw text and the labelled; the ratio at which it is halved; the length of a run of one word that counts
PRIOR, SURE_RAW, SURE, SMALL, RUN = 1.0, 12.0, 10.0, 0.3, 6
COUNTS = ("raw", "target", "bad")
CAPS, REPEAT = U(0x1234567), U(0x7654321)
KIND = np.where(SPACE, 0, 2).astype(np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of each text: words, runs of symbols, neighbouring pairs, and two shapes (a word in capitals, a word RUN times in a row)."""
    buf, offs = flat(column)
    n = int(offs[-1])
    kind = KIND[buf[:n]]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    border = np.append(np.flatnonzero(new), n)
    solid = np.flatnonzero(kind[border[:-1]] > 0) if n else np.empty(0, np.int64)
    start, end = border[:-1][solid], border[1:][solid]
    count = np.diff(np.searchsorted(start, offs))
    h = span_hash(LOWER[buf], start, end)
    doc = np.repeat(np.arange(len(count)), count)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    upper = np.concatenate([[0], np.cumsum((buf[:n] >= 65) & (buf[:n] <= 90))])
    capital = np.flatnonzero((upper[end] - upper[start] == end - start) & (end - start >= 4))
    plain = np.flatnonzero(kind[start] == 1)
    w, d = h[plain], doc[plain]
    same = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    run = np.concatenate([[0], np.cumsum(same)])
    repeat = d[np.flatnonzero(run[RUN - 1 :] - run[: max(len(run) - RUN + 1, 0)] == RUN - 1)]
    values = np.concatenate([h, mix(h[pair] * MULS[1] + h[pair + 1] * MULS[2] + U(1)), np.full(len(capital), CAPS), np.full(len(repeat), REPEAT)])
    owner = np.concatenate([doc, doc[pair], doc[capital], repeat])
    order = np.argsort(owner, kind="stable")
    return distinct(values[order], np.bincount(owner, minlength=len(count)))


def _buckets(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = mix(values)
    return (v & U(BUCKETS - 1)).astype(np.int64), (v >> U(40) & U(BUCKETS - 1)).astype(np.int64) + BUCKETS


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(counts), codec="zstd", asbytes=True)


def _unpacked(value: pa.Scalar, chunk: int, kind: type) -> np.ndarray:
    """The counts of a chunk; chunk -1 is one number."""
    size = (CHUNK if chunk >= 0 else 1) * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(value.as_buffer(), size, codec="zstd"), kind)


class Labels:
    """Ids and classes (1 good, 0 bad) of the labelled documents that are used."""

    def __init__(self, rows: list):
        ids, good = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        order = np.argsort(ids)
        self.ids, self.good = ids[order], good[order]

    def of(self, column: pa.Array) -> np.ndarray:
        """The class of each id, -1 without one."""
        out = np.full(len(column), -1, np.int64)
        if len(self.ids):
            ids = column.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            hit = self.ids[at] == ids
            out[hit] = self.good[at[hit]]
        return out


def labelled(labels: DataFrame, most: int) -> Labels:
    """A bounded sample of the labels by the hash of their id; of several rows for an id, the worst counts. Good: quality 1 and not toxic."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    return Labels([tuple(r) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()])


def _count(labels, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros((3, 2 * BUCKETS), np.int32), np.zeros(3, np.int32)
        for batch in slices(batches, text_col, SLICE):
            values, count = features(batch.column(text_col))
            kind = labels.value.of(batch.column(id_col))
            sets = (kind >= -1, kind == 1, kind == 0)
            for b in _buckets(values):
                for t, of in zip(total, sets, strict=True):
                    np.add.at(t, b[np.repeat(of, count)], 1)
            docs += np.array([of.sum() for of in sets], np.int32)
        if docs[0]:
            salt = int(mix(np.array([docs[0]], U) + total[0, :1].astype(U))[0] % U(SALTS))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 3)
            # chunk by chunk and compressed: neither the worker nor the JVM holds all counts a second time
            for c in range(-1, 2 * BUCKETS // CHUNK):
                part = (c, salt, *[_packed(t[c * CHUNK : (c + 1) * CHUNK] if c >= 0 else docs[i : i + 1]) for i, t in enumerate(total)])
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(part, kinds, strict=True)], names=["chunk", "salt", *COUNTS])

    return run


def _add(kind: type):
    """Sums, as 64-bit numbers, of the arrays of ``kind`` that share a chunk (and salt)."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        total = {c: _packed(sum(_unpacked(x, chunk, kind).astype(np.int64) for x in table.column(c))) for c in COUNTS}
        return pa.table({"chunk": table.column("chunk")[:1], **({"salt": table.column("salt")[:1]} if "salt" in table.column_names else {}), **{c: pa.array([b], pa.binary()) for c, b in total.items()}})

    return run


def _shrunken(target: np.ndarray, among: np.ndarray, share: float, surprise: np.ndarray, sure: float) -> np.ndarray:
    """Log ratios of ``target`` to its ``share`` of ``among``, nearer to 0 the less sure and the smaller they are."""
    log = np.log((target + PRIOR * share) / ((among + PRIOR) * share))
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(log == 0, 0.0, log / (1 + (sure / surprise) ** 8) / (1 + (SMALL / log) ** 4))


def ratios(raw: np.ndarray, target: np.ndarray, bad: np.ndarray, n_raw: int, n_target: int, n_bad: int) -> np.ndarray:
    """Shrunken log ratios of the buckets, of the target to the raw text or to all labelled documents, whichever says more.

    They are multiples of 2 ** -16, whose sums are exact in any order.
    """
    raw, target, bad = (np.maximum(x, 0).astype(np.float64) for x in (raw, target, bad))
    if n_raw <= 0 or n_target <= 0:
        return np.zeros(len(raw), np.float32)
    share, part = n_target / n_raw, n_target / (n_target + max(n_bad, 0))
    both = target + bad
    with np.errstate(divide="ignore", invalid="ignore"):
        # twice the log likelihood ratio of the counts to what the share lets expect
        far = 2 * (np.where(target > 0, target * np.log(target / (raw * share)), 0) - (target - raw * share))
        by_raw = _shrunken(target, raw, share, np.maximum(far, 0), SURE_RAW)
        far = 2 * (np.where(target > 0, target * np.log(target / (both * part)), 0) + np.where(bad > 0, bad * np.log(bad / (both * (1 - part))), 0))
        by_label = _shrunken(target, both, part, np.maximum(far, 0), SURE)
    out = np.where(np.abs(by_raw) > np.abs(by_label), by_raw, by_label)
    return (np.round(out * 65536) / 65536).astype(np.float32)


def models(counts: np.ndarray, docs: list[int]) -> np.ndarray:
    """The ratios for documents labelled bad, labelled good (their own count taken out) and unlabelled, a row for each."""
    taken_out = ((1, 0, 1), (1, 1, 0), (0, 0, 0))
    return np.stack([ratios(*[x - o for x, o in zip(counts, own, strict=True)], *[n - o for n, o in zip(docs, own, strict=True)]) for own in taken_out])


def _rated(docs: list[int]):
    """The models of each chunk of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.stack([_unpacked(batch.column(c)[i], 0, np.int64) for c in COUNTS])
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), pa.array([models(counts, docs).tobytes()], pa.binary())], names=["chunk", "ratios"])

    return run


def weights(column: pa.Array, kind: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The log weight of each text of a class (``Labels.of``), SLICE bytes at a time."""
    rows = pa.RecordBatch.from_arrays([column, pa.array(kind)], names=["text", "kind"])
    return np.concatenate([np.empty(0), *[_weights(x.column("text"), x.column("kind").to_numpy(), model) for x in slices(iter([rows]), "text", SLICE)]])


def _weights(column: pa.Array, kind: np.ndarray, model: np.ndarray) -> np.ndarray:
    values, count = features(column)
    a, b = _buckets(values)
    at = np.repeat(np.where(kind < 0, 2, kind) * (2 * BUCKETS), count)
    x, y = model[a + at], model[b + at]
    weaker = np.where(np.sign(x) == np.sign(y), np.where(np.abs(x) < np.abs(y), x, y), 0)
    sums = np.concatenate([[0.0], np.cumsum(weaker, dtype=np.float64)])
    return sums[np.cumsum(count)] - sums[np.cumsum(count) - count]


def gumbel(column: pa.Array, ids: pa.Array, seed: int) -> np.ndarray:
    """Noise that depends on the row's id and text alone."""
    buf, offs = flat(column)
    h = mix(span_hash(buf, offs[:-1], offs[1:]) + mix(ids.cast(pa.int64()).fill_null(-1).to_numpy().astype(U)) * MULS[2] + U(seed * int(MULS[3]) % 2**64))
    u = ((h >> U(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def ordered(x: np.ndarray) -> np.ndarray:
    """Signed words in the order of the numbers."""
    i = np.ascontiguousarray(x + 0.0).view(np.int64)
    return np.where(i < 0, i ^ np.int64(0x7FFFFFFFFFFFFFFF), i)


def kth_largest(keys: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column, by four counts of 16 bits each; no rows are gathered."""
    low, left = None, k
    rows = keys.select(F.col(column).bitwiseXOR(F.lit(-(1 << 63))).alias("v"))
    prefix = 0
    for shift in (48, 32, 16, 0):
        at = rows if low is None else rows.where(F.shiftrightunsigned("v", shift + 16) == F.lit(prefix))
        counts = {r.d: r.n for r in at.groupBy(F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(0xFFFF)).alias("d")).agg(F.count("*").alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if counts[d] >= left:
                break
            left -= counts[d]
        prefix, low = prefix << 16 | d, d
    v = prefix ^ (1 << 63)
    return v - (1 << 64) if v >> 63 else v


@steps("importance")
def select(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, most_labels: int = 50_000, seed: int = 0, scratch: Scratch) -> DataFrame:
    """The selected rows of ``docs``, all columns, and ``log_weight`` and ``sample_key``.

    ``labels`` has doc_id, quality and toxic. The sample has round(share * rows)
    rows. ``share`` is by default the share of good documents among the labelled
    ones that are used, and 1 if there are no good or no bad ones. Without good
    labels every document has weight one.

    Null text counts as empty and has weight one. Rows with a null or unlabelled
    id are scored like all others. Equal rows have equal keys and are selected
    together, even beyond k. Input columns of the two new names are replaced, all
    others pass unchanged. Empty tables of documents or labels are allowed; an empty
    one of documents gives an empty result.
    """
    if share is not None and not 0 <= share <= 1:
        raise ValueError(f"share {share} is not from 0 to 1")
    spark = docs.sparkSession
    docs = docs.drop("log_weight", "sample_key")
    held = spark.sparkContext.broadcast(labelled(labels, most_labels))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_count(held, "id", "text"), "chunk int, salt int, raw binary, target binary, bad binary")
    counted = counted.groupBy("chunk", "salt").applyInArrow(_add(np.int32), "chunk int, salt int, raw binary, target binary, bad binary").drop("salt").groupBy("chunk").applyInArrow(_add(np.int64), "chunk int, raw binary, target binary, bad binary")
    counted = scratch.write(counted, "counts")
    sums = counted.where("chunk < 0").select(*COUNTS).first()
    total = [int(_unpacked(pa.scalar(bytes(x)), -1, np.int64)[0]) for x in sums] if sums else [0, 0, 0]
    ready = np.zeros((3, 2 * BUCKETS), np.float32)
    # executors make the ratios; the driver only holds the model, whose size is fixed
    for r in counted.where("chunk >= 0").mapInArrow(_rated(total), "chunk int, ratios binary").toLocalIterator():
        ready[:, r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.ratios, np.float32).reshape(3, -1)
    model = spark.sparkContext.broadcast(ready.ravel())
    del ready

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = weights(batch.column("text"), held.value.of(batch.column("id")), model.value)
            yield pa.RecordBatch.from_arrays([pa.array(ordered(w + gumbel(batch.column("text"), batch.column("id"), seed)))], names=["key"])

    keys = scratch.write(rows.mapInArrow(score, "key long"), "keys")
    if share is None:
        share = total[1] / (total[1] + total[2]) if total[1] and total[2] else 1.0
    k = round(share * total[0])
    least = kth_largest(keys, "key", k) if k else (1 << 63) - 1
    scratch.close()
    schema = T.StructType([*docs.schema.fields, T.StructField("log_weight", T.DoubleType()), T.StructField("sample_key", T.DoubleType())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            text, ids = batch.column(text_col), batch.column(id_col)
            w = weights(text, held.value.of(ids), model.value)
            key = w + gumbel(text, ids, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w), pa.array(key)], names=schema.names).filter(pa.array(ordered(key) >= least))

    return docs.mapInArrow(keep, schema)
