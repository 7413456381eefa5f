"""Text files of any size by lines: written in order by one task, read in blocks whose readers know what went before.

A format in which a line's meaning depends on earlier lines is read in two
passes. The first makes a small summary of each block of a file; the driver
goes through the summaries in order and finds the state at each block's start;
the second reads every block from its state.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A block: its file (a hash of the path), its start and its length.
Block = tuple[int, int, int]


def write_lines(lines: DataFrame, by: Sequence[str | Column], path: str, mode: str = "errorifexists") -> None:
    """One file of ``value`` in the order of ``by``, which one task sorts (beyond its memory on disk) and writes."""
    lines.repartition(1).sortWithinPartitions(*by).select("value").write.mode(mode).text(path)


#: Bytes of text that neighbouring lines are packed up to.
CHUNK = 1 << 16


def write_numbered(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file of the lines (part int, line long, value), which have distinct numbers, in the order of these.

    Lines that follow each other are packed where they are made, so that the
    one task that writes sorts compressed packs and not lines, and holds the text
    of some packs at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part, line = (batch.column(c).to_numpy() for c in ("part", "line"))
                values = pc.fill_null(batch.column("value").cast(pa.binary()), b"")
                size = np.cumsum(pc.binary_length(values).to_numpy().astype(np.int64) + 1) // CHUNK
                cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(line) != 1) | (np.diff(size) != 0)) + 1
                at = np.concatenate([[0], cuts, [len(values)]])
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), values), b"\n")
                yield pa.RecordBatch.from_arrays([pa.array(part[at[:-1]], pa.int32()), pa.array(line[at[:-1]], pa.int64()), pa.array([zlib.compress(t.as_py(), 1) for t in texts], pa.binary())], names=["part", "line", "pack"])

    packs = lines.select("part", "line", "value").mapInArrow(pack, "part int, line long, pack binary")
    unpack = F.udf(zlib.decompress, "binary", useArrow=False)  # a hundred packs a time, where a batch of Arrow has thousands
    packs.repartition(1).sortWithinPartitions("part", "line").select(unpack("pack").cast("string").alias("value")).write.mode(mode).text(path)


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, start, length, value): lines in order within the block of the file that they start in."""
    m = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(list(paths)).select(F.xxhash64(m["file_path"]).alias("file"), m["file_block_start"].alias("start"), m["file_block_length"].alias("length"), "value")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Iterator[list]]]:
    """The blocks of a task, each with its lines in lists of one batch at most; where lines have a place ``at``, with pairs of both."""

    def runs() -> Iterator[tuple[Block, list]]:
        for batch in batches:
            more = "at" in batch.schema.names
            ids = np.stack([batch.column(c).to_numpy() for c in ("file", "start", "length")], 1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    own = batch.slice(a, b - a)
                    lines = own.column("value").to_pylist()
                    yield tuple(ids[a].tolist()), list(zip(own.column("at").to_pylist(), lines, strict=True)) if more else lines

    for block, own in groupby(runs(), key=lambda r: r[0]):
        yield block, (x for _, x in own)


def summaries(lines: DataFrame, summary: Callable[[Iterator[list], Block], Any]) -> dict[int, list[tuple[Block, Any]]]:
    """The blocks' summaries by file, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in blocks(batches):
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "length"), block, strict=True)) | {"made": pickle.dumps(summary(own, block))}])

    out: dict[int, list] = {}
    for r in sorted(lines.mapInArrow(run, "file long, start long, length long, made binary").collect(), key=lambda r: (r.file, r.start)):  # a small row for each block
        out.setdefault(r.file, []).append(((r.file, r.start, r.length), pickle.loads(r.made)))
    return out


def from_states(lines: DataFrame, states: dict[Block, Any], rows: Callable[[Iterator[list], Any, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``rows`` makes of each block's lines, the state at its start, and the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in blocks(batches):
            if block not in states:
                raise RuntimeError("the file is read in other blocks than before; read it anew")
            yield from rows(own, states[block], block[1])

    return lines.mapInArrow(run, schema)


def number(c: Column) -> Column:
    """A number in the shortest text that reads back as the same."""
    c = c.cast("double")
    return F.when((c == F.rint(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
