"""Near-duplicate documents by Circulant MinHash.

Two permutations, of which the second is circularly shifted, give all signature
coordinates; bands of coordinates give candidates; every link is confirmed on
the full shingle sets. The result is the connected components of the links.

How it stays linear where copies are many:

* documents with equal shingle sets form a class by a 128-bit digest of the set;
  one representative goes on;
* a bucket of a band never emits its pairs. It gives a star around its smallest
  id, of which the likely pairs (by a sketch of 128 bytes) are contracted to
  clusters;
* only buckets that then still hold several clusters are looked at again, and
  give a spanning forest of their likely pairs at most;
* the full sets of a cluster meet in one task, where its likely pairs are
  confirmed unless both are known to be connected; a task gives a spanning forest of
  its links at most;
* buckets of more than ``block`` rows and clusters of more than CLUSTER_BYTES are
  written in blocks, each once, and every two blocks are compared in a task that
  reads them by name. Rows and shuffled bytes stay in proportion to the group;
  what is read and compared grows with its square, divided among tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Batches
from .components import components
from .scratch import Scratch, partitions, steps
from .textvec import MULS, SPACE, U, Circulant, distinct, mix, shingles, signed, slices, word_hashes

BANDS, ROWS, SKETCH, LEAST = 36, 5, 128, 80
CLUSTER_BYTES, TASK_BYTES = 16 << 20, 64 << 20


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingles(*word_hashes(column, SPACE), k))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(BANDS * ROWS)
        for batch in slices(batches, "text"):
            values, count = shingle_sets(batch.column("text"), k)
            full = np.flatnonzero(count)
            starts = np.concatenate([[0], np.cumsum(count)])[:-1][full]
            fp = np.zeros((2, len(count)), U)
            for i in range(2):
                if len(full):
                    fp[i, full] = np.add.reduceat(mix(values * MULS[i] + MULS[i + 2]), starts)
            sig = circulant(values, count)
            keys = np.zeros((len(count), BANDS), U)
            for b in range(BANDS):
                h = np.full(len(count), b + 1, U) * MULS[0]
                for r in range(ROWS):
                    h = mix(h ^ (sig[:, b * ROWS + r].astype(U) * MULS[1]))
                keys[:, b] = h
            sketch = np.ascontiguousarray((sig[:, :SKETCH] & np.uint32(255)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(count.astype(np.int64)),
                    pa.array(signed(fp[0])),
                    pa.array(signed(fp[1])),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(count) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(signed(keys.ravel()))),
                    pa.array([bytes(x) for x in sketch], pa.binary()),
                ],
                names=["doc_id", "n", "fp1", "fp2", "bands", "sketch"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, count = shingle_sets(batch.column("text"), k)
            ends = np.cumsum(count)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([values[e - c : e].tobytes() for c, e in zip(count, ends, strict=True)], pa.binary())], names=["id", "members"])

    return run


class Union:
    """Disjoint sets of row numbers; ``label`` names the set of each row."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Put the sets of ``others`` and of ``i`` together; one row of each set that was another."""
        found, at = np.unique(self.label[others], return_index=True)
        new = found != self.label[i]
        self.label[np.isin(self.label, found[new])] = self.label[i]
        return others[at[new]]


def _groups(keys: list[str], work):
    """Run ``work`` over each whole group of rows that arrive sorted by ``keys``; it yields (a, b) arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [table.column(c).to_numpy() for c in keys]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            found = [x for s, e in zip([0, *cut], [*cut, table.num_rows], strict=True) for x in work(table.slice(s, e - s))]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(c)[batch.num_rows - 1] for c in keys]
            if all(held[0].column(c)[0] == v for c, v in zip(keys, last, strict=True)):
                continue
            table = pa.Table.from_batches(held)
            other = np.any([table.column(c).to_numpy() != v.as_py() for c, v in zip(keys, last, strict=True)], axis=0)
            whole = int(np.flatnonzero(other)[-1]) + 1
            yield from emit(table.slice(0, whole))
            held = [b for b in table.slice(whole).to_batches() if b.num_rows]
        if held:
            yield from emit(pa.Table.from_batches(held))

    return run


def _matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, SKETCH)


def _likely(sizes: np.ndarray, sketch: np.ndarray, i: int, j: np.ndarray, percent: int) -> np.ndarray:
    """Those rows ``j`` that may be linked with ``i``: by size for certain, by sketch but for one pair in a million."""
    j = j[100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i])]
    return j[np.count_nonzero(sketch[j] == sketch[i], axis=1) >= LEAST] if len(j) else j


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    side = table.column("side").to_numpy()
    return np.flatnonzero(side == p), np.flatnonzero(side == q), p == q


def _forest(percent: int):
    """Likely pairs that connect the clusters of one bucket (or of two of its blocks), no more than a spanning forest needs."""

    def work(table: pa.Table):
        if table.num_rows < 2:
            return
        ids, sizes, sketch, union = table.column("id").to_numpy(), table.column("n").to_numpy(), _matrix(table), Union(table.column("component").to_numpy())
        rows, cols, same = _sides(table)
        for i in rows:
            j = cols[cols > i] if same else cols
            j = _likely(sizes, sketch, i, j[union.label[j] != union.label[i]], percent)
            if len(j):
                new = union.join(i, j)
                yield np.full(len(new), ids[i]), ids[new]

    return work


def _exact(percent: int):
    """Links of one cluster (or of two of its blocks) confirmed on full sets, no more than a spanning forest needs."""

    def work(table: pa.Table):
        if table.num_rows < 2:
            return
        ids, sizes, sketch, union = table.column("id").to_numpy(), table.column("n").to_numpy(), _matrix(table), Union(np.arange(table.num_rows))
        code = np.unique(np.frombuffer(b"".join(table.column("members").to_pylist()), U), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        marked = np.zeros(int(code.max()) + 1, np.int64)
        rows, cols, same = _sides(table)
        for i in rows:
            j = cols[cols > i] if same else cols
            j = _likely(sizes, sketch, i, j[union.label[j] != union.label[i]], percent)
            if not len(j):
                continue
            own = code[ends[i] - sizes[i] : ends[i]]
            marked[own] = 1
            offs = np.cumsum(sizes[j]) - sizes[j]
            at = np.arange(int(sizes[j].sum())) + np.repeat(ends[j] - sizes[j] - offs, sizes[j])
            both = np.add.reduceat(marked[code[at]], offs)
            marked[own] = 0
            j = j[100 * both >= percent * (sizes[i] + sizes[j] - both)]
            if len(j):
                new = union.join(i, j)
                yield np.full(len(new), ids[i]), ids[new]

    return work


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch", "pivot_sketch"))
            yield batch.select(["a", "b"]).filter(pa.array(np.count_nonzero(x == y, axis=1) >= LEAST))


def _compared(rows: DataFrame, key: str, count: str, columns: list[str], work, n: int, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) pairs that ``work`` finds within the groups of ``key``: in one task, or between blocks where ``count`` of them are needed."""
    columns = [key, "id", *columns]
    alone = rows.where(F.col(count) <= 1).select(*columns, *[F.lit(0).alias(c) for c in ("side", "p", "q")])
    out = alone.repartition(n, key).sortWithinPartitions(key, "id").mapInArrow(_groups([key], work), "a long, b long")

    held = Batches(scratch, f"{name}_blocks")

    def put(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        b = held.put(table.to_batches())
        return pa.table({key: table.column(key)[:1], "side": table.column("side")[:1], "b": pa.array([b], pa.int64())})

    large = rows.where(F.col(count) > 1).withColumn("side", F.expr(f"int(pmod(xxhash64(id, 7), {count}))")).select(*columns, "side")
    blocks = scratch.write(large.groupBy(key, "side").applyInArrow(put, f"{key} long, side int, b long"), f"{name}_files")
    if not blocks.head(1):
        return out
    other = blocks.select(key, F.col("side").alias("q"), F.col("b").alias("other"))
    pairs = scratch.write(blocks.withColumnRenamed("side", "p").join(other.hint("merge"), key).where("p <= q").select("p", "q", "b", "other"), f"{name}_pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                table = pa.concat_tables([held.read(x) for x in ([r["b"]] if r["p"] == r["q"] else [r["b"], r["other"]])])
                for c in "pq":
                    table = table.append_column(c, pa.array(np.full(table.num_rows, r[c], np.int32)))
                for a, b in work(table):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return out.union(pairs.repartition(max(1, 2 * pairs.count()), "b", "other").mapInArrow(compare, "a long, b long"))


@steps("near")
def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, block: int = 2000, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, with A-Z lowered. A
    document's set holds its distinct ``shingle``-word shingles; of fewer words,
    the whole sequence; documents without words have an empty set, which links
    with nothing. Two documents are linked if 100 * |both| >= percent * |either|.
    ``component_id`` is the smallest id reachable over links; ``kept`` says that
    it is the document's own.

    Null text counts as empty. A row with a null id is linked with nothing and
    has null ``component_id`` and ``kept``. Rows that repeat an id are one
    document with several texts: each is a row of the result, with one component.
    An empty table gives an empty result. Other columns are not read. A pair at
    exactly 0.8 misses all bands with probability (1 - 0.8**5)**36 < 1e-6.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = scratch.write(docs.mapInArrow(_signatures(shingle), "doc_id long, n long, fp1 long, fp2 long, bands array<long>, sketch binary"), "sigs")
    real = sigs.where("n > 0 and doc_id is not null")
    classes = scratch.write(real.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    reps = scratch.write(real.join(classes, ["fp1", "fp2", "n"], "left").where("rep is null or rep = doc_id").select(F.col("doc_id").alias("id"), "n", "bands", "sketch"), "reps")

    banded = reps.select("id", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("pivot")).where("c > 1")
    buckets = scratch.write(banded.join(shared, "key").select("key", "id", "n", "c", "pivot"), "buckets")
    sketches = reps.select("id", "n", "sketch")
    stars = buckets.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = stars.join(sketches.withColumnRenamed("id", "a").hint("merge"), "a").join(sketches.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("pivot_sketch")).hint("merge"), "b")
    stars = stars.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("a", "b", "sketch", "pivot_sketch").mapInArrow(_stars, "a long, b long")
    near = components(stars, scratch, "near")

    tagged = buckets.join(near.hint("merge"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = tagged.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / block).alias("nb")).where("lo < hi").select("key", "nb")
    rest = tagged.join(mixed.hint("merge"), "key").join(reps.select("id", "sketch").hint("merge"), "id")
    tasks = max(partitions(spark), 8 * (sigs.agg(F.sum("n")).first()[0] or 0) // TASK_BYTES)
    forest = scratch.write(_compared(rest, "key", "nb", ["component", "n", "sketch"], _forest(percent), tasks, scratch, "forest"), "forest")
    clusters = components(near.select(F.col("id").alias("a"), F.col("component").alias("b")).union(forest), scratch, "clusters")
    scratch.drop("buckets", "forest", "forest_blocks")

    clusters = scratch.write(clusters.union(clusters.select("component", "component")).distinct(), "members")
    sets = docs.join(clusters.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(shingle), "id long, members binary")
    held = clusters.join(sketches.hint("merge"), "id")
    count = held.groupBy("component").agg(F.ceil(8 * F.sum("n") / CLUSTER_BYTES).alias("nb"))
    held = held.join(count.hint("merge"), "component").join(sets.hint("merge"), "id").where(F.octet_length("members") == 8 * F.col("n"))
    links = scratch.write(_compared(held, "component", "nb", ["n", "sketch", "members"], _exact(percent), tasks, scratch, "links"), "links")
    final = components(links, scratch, "cc")
    out = sigs.join(classes, ["fp1", "fp2", "n"], "left").withColumn("id", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))).join(final, "id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    result = scratch.write(out, "result")
    scratch.close("result")
    return result
