"""Tables behind pictures: corners of tiles, decibels, units of a time axis, responses, similar images."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators import kernels as K


def tile_corners(x: Column, y: Column, w: Column, h: Column, anchor: str = "center") -> Column:
    """struct<x0, x1, y0, y1> of rectangles by their centre or one of the corners ll, lr, ul, ur."""
    dx = {"center": 0.5, "ll": 0.0, "ul": 0.0, "lr": 1.0, "ur": 1.0}[anchor]
    dy = {"center": 0.5, "ll": 0.0, "lr": 0.0, "ul": 1.0, "ur": 1.0}[anchor]
    x0, y0 = x - w * dx, y - h * dy
    return F.struct(x0.alias("x0"), (x0 + w).alias("x1"), y0.alias("y0"), (y0 + h).alias("y1"))


def decibels(a: Column, *, power: bool = False) -> Column:
    return (10 if power else 20) * F.log10(a)


def bode(re: Column, im: Column) -> Column:
    """struct<magnitude in dB, phase in degrees> of a complex value."""
    return F.struct(decibels(F.hypot(re, im)).alias("magnitude"), F.degrees(F.atan2(im, re)).alias("phase"))


def filter_table(spark: SparkSession, filt, frequencies: Sequence[float], *, fs: float = 1.0, analog: bool = False) -> DataFrame:
    """(f, magnitude in dB, phase in degrees) of a filter."""
    z = K.frequency_response(filt, np.asarray(frequencies, float), fs, analog)
    return spark.createDataFrame([(float(f), float(20 * np.log10(abs(v))) if abs(v) else -float("inf"), float(np.degrees(np.angle(v)))) for f, v in zip(frequencies, z, strict=True)], "f double, magnitude double, phase double")


#: Units of a time axis and their seconds, largest first.
TIME_UNITS = [("years", 31557600), ("weeks", 604800), ("days", 86400), ("hours", 3600), ("minutes", 60), ("seconds", 1)]


def axis_unit(span: Column, least: float = 4.0) -> Column:
    """The largest unit that a span holds at least ``least`` times."""
    out = F.lit("seconds")
    for name, s in reversed(TIME_UNITS[:-1]):
        out = F.when(span >= least * s, name).otherwise(out)
    return out


def similar(vectors: DataFrame, queries: DataFrame, *, id_col: str, vector_col: str, k: int, block_bytes: int = 16 << 20) -> DataFrame:
    """(query, id, cosine): the k vectors most like each query vector, itself left out; ties by id.

    The queries are a stated set. They are searched for in blocks of at most about
    ``block_bytes`` (measured on their arrays), each a broadcast matrix; a task
    multiplies its vectors with it, a batch at a time, and keeps its best k of each
    query before they meet. Null vectors and those of another length or of no length
    in space match nothing.
    """
    spark = vectors.sparkSession
    of = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    asked = of(queries)
    size = asked.agg(F.sum(8 * (F.size("v") + 2))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        held = spark.sparkContext.broadcast((rows.column("id").to_numpy(), [np.array(x, float) for x in rows.column("v").to_pylist()]))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, arrays = held.value
            by_length = {n: np.flatnonzero([len(a) == n for a in arrays]) for n in {len(a) for a in arrays}}
            units = {n: np.stack([arrays[i] for i in at]) for n, at in by_length.items() if n}
            for n, m in units.items():
                with np.errstate(invalid="ignore", divide="ignore"):
                    units[n] = m / np.sqrt((m * m).sum(1))[:, None]
            best: dict[int, list[tuple[float, int]]] = {}
            for batch in batches:
                column = batch.column("v")
                lengths = pc.list_value_length(column).to_numpy()
                own = batch.column("id").to_numpy()
                for n in set(lengths.tolist()) & set(units):
                    at = np.flatnonzero(lengths == n)
                    m = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        # rounded, so that equal vectors tie wherever they lie in a batch
                        likeness = np.round(units[n] @ (m / np.sqrt((m * m).sum(1))[:, None]).T, 12)
                    for row, q in zip(likeness, by_length[n].tolist(), strict=True):
                        use = np.flatnonzero((own[at] != ids[q]) & ~np.isnan(row))
                        order = use[np.lexsort((own[at][use], -row[use]))[:k]]
                        best[q] = sorted([*best.get(q, []), *zip((-row[order]).tolist(), own[at][order].tolist(), strict=True)])[:k]
            rows = [(int(ids[q]), i, -c) for q, found in best.items() for c, i in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "id", "cosine"])

        part = of(vectors).mapInArrow(search, "query long, id long, cosine double")
        out = part if out is None else out.union(part)
    near = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return out.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).select("query", "id", "cosine")
