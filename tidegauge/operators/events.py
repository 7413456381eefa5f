"""Event tables: rates, histograms, clustering, time columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.filters import OPERATORS

TIME_NAMES = ("time", "gps")


def time_column(df: DataFrame) -> str:
    """The one column called time or gps, or of type decimal(19,9); an error unless there is exactly one."""
    found = [n for n, t in df.dtypes if n.lower() in TIME_NAMES or t == "decimal(19,9)"]
    if len(found) != 1:
        raise ValueError(f"cannot tell the time column from {found or df.columns}")
    return found[0]


def _bounds(df: DataFrame, time: str, start: float | None, end: float | None, by: Sequence[str]) -> DataFrame:
    lo = F.min(time).cast("double") if start is None else F.lit(float(start))
    hi = F.max(time).cast("double") if end is None else F.lit(float(end))
    return df.groupBy(*by).agg(lo.alias("__s"), hi.alias("__e"))


def event_rate(df: DataFrame, stride: float, *, time: str | None = None, start: float | None = None, end: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, time, rate): events a second in steps of ``stride`` from ``start`` to ``end`` (by default the first and last event).

    There are ceil((end - start) / stride) bins, empty ones included; all are
    half-open, but the last also counts its right edge. Events outside are dropped.
    """
    return binned_event_rates(df, stride, [(F.lit(True), "")], time=time, start=start, end=end, by=by).drop("series")


def binned_event_rates(df: DataFrame, stride: float, bins: Sequence[tuple[Column, str]], *, time: str | None = None, start: float | None = None, end: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., series, bin, time, rate): one rate for each named condition of ``bins``, which may overlap; see ``value_bins``.

    All conditions are counted in one pass over the events.
    """
    time = time or time_column(df)
    bounds = _bounds(df, time, start, end, by)
    rows = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))  # without keys, one row of bounds
    t, n = F.col(time).cast("double"), F.ceil((F.col("__e") - F.col("__s")) / stride)
    nth = F.least(F.floor((t - F.col("__s")) / stride), n - 1).cast("long")
    inside = (t >= F.col("__s")) & (t <= F.col("__s") + n * stride) & (n > 0)
    counts = rows.where(inside).groupBy(*by, nth.alias("bin")).agg(*[F.count(F.when(c, 1)).alias(f"__{i}") for i, (c, _) in enumerate(bins)])
    grid = bounds.where(n > 0).select(*by, "__s", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin"))
    full = grid.join(counts, [*by, "bin"], "left")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("series"), F.coalesce(f"__{i}", F.lit(0)).alias("c")) for i, (_, name) in enumerate(bins)]))
    return full.select(*by, "bin", "__s", each.alias("e")).select(*by, "e.series", "bin", (F.col("__s") + F.col("bin") * stride).alias("time"), (F.col("e.c") / stride).alias("rate"))


def value_bins(column: str, bins: Sequence[Any], operator: str = ">=") -> list[tuple[Column, str]]:
    """Named conditions: pairs are [lo, hi); with ``in`` the numbers are consecutive edges; else ``column operator number``."""
    c = F.col(column)
    if not bins:
        return [(F.lit(True), f"{column} {operator} all")]
    if operator == "in" and not isinstance(bins[0], tuple | list):
        bins = list(zip(bins[:-1], bins[1:], strict=True))
    if isinstance(bins[0], tuple | list):
        return [((c >= lo) & (c < hi), f"{column} {operator} ({lo}, {hi})") for lo, hi in bins]
    return [(OPERATORS[operator](c, F.lit(b)), f"{column} {operator} {b}") for b in bins]


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float, *, log: bool = False) -> DataFrame:
    """(bin, lo, hi, count) of ``bins`` equal (or equal-ratio) bins over [low, high]; the last is closed, empty ones are zero."""
    f = F.log10 if log else (lambda x: x)
    a, b = f(F.lit(float(low))), f(F.lit(float(high)))
    x = F.col(column).cast("double")
    nth = F.least(F.floor((f(x) - a) / (b - a) * bins), F.lit(bins - 1)).cast("long")
    counts = df.where((x >= low) & (x <= high)).groupBy(nth.alias("bin")).agg(F.count("*").alias("count"))
    edge = (lambda i: F.pow(F.lit(10.0), a + (b - a) * i / bins)) if log else (lambda i: a + (b - a) * i / bins)
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin"), edge(F.col("id")).alias("lo"), edge(F.col("id") + 1).alias("hi"))
    return grid.join(F.broadcast(counts), "bin", "left").select("bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def cluster(df: DataFrame, index: str, rank: str, window: float, *, by: Sequence[str] = (), tie: Sequence[str] = (), coarse: float | None = None) -> DataFrame:
    """The row of largest ``rank`` of each chain of rows whose ``index`` gaps are at most ``window``; ties go to the first by index, then ``tie``.

    With ``coarse`` (a stretch of the index), stretches are chained apart, so that
    neither a table without keys nor a hot key is one task: rows know their
    predecessor through the last index of the stretches before, a table with a
    row for each key and stretch.
    """
    if window <= 0:
        raise ValueError("the window must be positive")
    keys = [F.col(k) for k in by]
    order = [F.col(index), *[F.col(t) for t in tie]]
    running = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if coarse:
        df = df.withColumn("__part", F.floor(F.col(index) / coarse))
        at, parts = [*by, "__part"], Window.partitionBy(*keys, *[F.lit(0)] * (not by)).orderBy("__part")
        ends = df.groupBy(*at).agg(F.max(index).alias("__last")).select(*at, F.lag("__last").over(parts).alias("__before"))
        df = df.join(ends, at)
        w = Window.partitionBy(*[F.col(k) for k in at]).orderBy(*order)
        gap = F.col(index) - F.coalesce(F.lag(index).over(w), F.col("__before"))
        df = df.withColumn("__new", F.when(gap <= window, 0).otherwise(1))
        heads = df.groupBy(*at).agg(F.sum("__new").alias("__n")).select(*at, (F.sum("__n").over(parts) - F.col("__n")).alias("__base"))
        df = df.join(heads, at).withColumn("__chain", F.col("__base") + F.sum("__new").over(running(w)))
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
        df = df.withColumn("__new", F.when(F.col(index) - F.lag(index).over(w) <= window, 0).otherwise(1))
        df = df.withColumn("__chain", F.sum("__new").over(running(w)))
    best = Window.partitionBy(*[F.col(k) for k in by], "__chain").orderBy(F.desc(rank), *order)
    return df.withColumn("__nth", F.row_number().over(best)).where("__nth = 1").drop(*[c for c in ("__nth", "__new", "__chain", "__part", "__before", "__base")])
