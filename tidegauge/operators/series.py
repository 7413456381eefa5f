"""Sampled series in long form: rows (channel, idx, x, value); a channel is any set of key columns.

``idx`` counts samples, ``x = x0 + idx * dx``. Operators that only move or select
samples are projections; those that look at neighbours use one window by key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("channel",)
TOLERANCE = 2.0**-18


def _w(keys: Sequence[str]):
    return Window.partitionBy(*[F.col(k) for k in keys]).orderBy("idx")


def from_arrays(df: DataFrame, samples: str, *, x0: float | Column = 0.0, dx: float | Column = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Long form of rows that hold an array of samples."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    rows = df.select(*keys, as_col(x0).alias("__x0"), as_col(dx).alias("__dx"), F.posexplode(samples).alias("idx", "value"))
    return rows.select(*keys, F.col("idx").cast("long").alias("idx"), (F.col("__x0") + F.col("idx") * F.col("__dx")).alias("x"), F.col("value").cast("double").alias("value"))


def to_arrays(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Block form (keys..., x0, samples): the samples of each key in order of idx."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "x", "value"))).alias("s"))
    return rows.select(*keys, F.col("s")[0]["x"].alias("x0"), F.transform("s", lambda r: r["value"]).alias("samples"))


def axis(spark, start: float, step: float, num: int) -> DataFrame:
    """A regular axis (idx, x)."""
    return spark.range(num).select(F.col("id").alias("idx"), (F.lit(float(start)) + F.col("id") * step).alias("x"))


def is_regular(df: DataFrame, keys: Sequence[str] = KEYS, tolerance: float = 1e-8) -> DataFrame:
    """(keys..., regular): whether the second difference of x vanishes; false for fewer than two samples."""
    w = _w(keys)
    d2 = F.lead("x").over(w) - 2 * F.col("x") + F.lag("x").over(w)
    return df.select(*keys, d2.alias("__d")).groupBy(*keys).agg(((F.count("*") > 1) & (F.coalesce(F.max(F.abs("__d")), F.lit(0.0)) <= tolerance)).alias("regular"))


def crop(df: DataFrame, start: float | None = None, end: float | None = None, *, x0: float = 0.0, dx: float = 1.0) -> DataFrame:
    """Samples from floor((start - x0) / dx) up to, not including, floor((end - x0) / dx): a start between samples keeps the one before it."""
    if start is not None:
        df = df.where(F.col("idx") >= F.lit(math.floor((start - x0) / dx)))
    if end is not None:
        df = df.where(F.col("idx") < F.lit(math.floor((end - x0) / dx)))
    return df


def crop_irregular(df: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Samples with start <= x < end."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("x") >= start)
    if end is not None:
        cond = cond & (F.col("x") < end)
    return df.where(cond)


def take(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """The slice start:stop:step; idx counts anew, x stays with its sample."""
    cond = (F.col("idx") >= start) & ((F.col("idx") - start) % step == 0)
    if stop is not None:
        cond = cond & (F.col("idx") < stop)
    return df.where(cond).withColumn("idx", ((F.col("idx") - start) / step).cast("long"))


def value_at(df: DataFrame, x: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., value) of the first sample at exactly ``x``."""
    return df.where(F.col("x") == x).groupBy(*keys).agg(F.min_by("value", "idx").alias("value"))


def shift(df: DataFrame, by: float) -> DataFrame:
    return df.withColumn("x", F.col("x") + by)


def diff(df: DataFrame, n: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """The n-th difference; the first n samples go, idx starts at 0 again, x stays with the later sample."""
    w = _w(keys)
    terms = [((-1) ** k) * math.comb(n, k) * (F.lag("value", k).over(w) if k else F.col("value")) for k in range(n + 1)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return df.withColumn("__d", out).withColumn("__i", F.row_number().over(w)).where(F.col("__i") > n).select(*keys, (F.col("__i") - 1 - n).cast("long").alias("idx"), "x", F.col("__d").alias("value"))


def state_diff(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Where a boolean series differs from its last sample."""
    w = _w(keys)
    return df.withColumn("value", F.col("value") != F.lag("value").over(w)).where(F.col("value").isNotNull())


def pad(df: DataFrame, before: int, after: int, *, value: float = 0.0, dx: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``value`` for ``before`` samples ahead and ``after`` behind; idx starts at 0 again."""
    ends = df.groupBy(*keys).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.min("x").alias("x0"))
    new = F.concat(F.sequence(F.col("lo") - before, F.col("lo") - 1) if before else F.array().cast("array<bigint>"), F.sequence(F.col("hi") + 1, F.col("hi") + after) if after else F.array().cast("array<bigint>"))
    rows = ends.select(*keys, "lo", "x0", F.explode(new).alias("idx")).select(*keys, "idx", (F.col("x0") + (F.col("idx") - F.col("lo")) * dx).alias("x"), F.lit(float(value)).alias("value"))
    return df.select(*keys, "idx", "x", "value").unionByName(rows).withColumn("idx", F.col("idx") + before)


def append(a: DataFrame, b: DataFrame, *, dx: float, gap: str | None = None, fill: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """``b`` behind ``a``, by key; channels of one side alone are kept.

    ``gap`` says what happens between them: ``raise`` (an error, also for an
    overlap), ``pad`` (floor(gap / dx + 0.5) samples of ``fill``; the default if
    ``fill`` is given) or ``ignore`` (b follows at once, on the axis of a).
    """
    gap = gap or ("raise" if fill is None else "pad")
    span = lambda df, p: df.groupBy(*keys).agg(F.min("x").alias(f"__{p}0"), (F.max("x") + dx).alias(f"__{p}1"), F.max("idx").alias(f"__{p}n"))
    meet = span(a, "a").join(span(b, "b"), list(keys), "full").withColumn("__gap", F.coalesce(F.col("__b0") - F.col("__a1"), F.lit(0.0)))
    if gap == "raise":
        bad = F.abs("__gap") >= TOLERANCE
        meet = meet.withColumn("__pad", F.when(bad, F.raise_error(F.when(F.col("__gap") > 0, F.lit("cannot append: there is a gap")).otherwise(F.lit("cannot append: the series overlap"))).cast("long")).otherwise(F.lit(0).cast("long")))
    elif gap == "pad":
        meet = meet.withColumn("__pad", F.when(F.col("__gap") <= -TOLERANCE, F.raise_error(F.lit("cannot append: the series overlap")).cast("long")).otherwise(F.floor(F.col("__gap") / dx + 0.5)))
    else:
        meet = meet.withColumn("__pad", F.lit(0).cast("long"))
    first, shifted = F.coalesce(F.col("__an") + 1, F.lit(0)), F.coalesce(F.col("__a0"), F.col("__b0"))
    rows = meet.select(*keys, first.alias("__first"), "__pad", shifted.alias("__x0"))
    tail = b.join(rows, list(keys)).withColumn("__m", F.min("idx").over(Window.partitionBy(*[F.col(k) for k in keys])))
    idx = F.col("__first") + F.col("__pad") + F.col("idx") - F.col("__m")
    x = F.col("__x0") + idx * dx if gap == "ignore" else F.col("x")
    tail = tail.select(*keys, idx.alias("idx"), x.alias("x"), "value")
    between = rows.where("__pad > 0").select(*keys, "__x0", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__pad") - 1)).alias("idx"))
    between = between.select(*keys, "idx", (F.col("__x0") + F.col("idx") * dx).alias("x"), F.lit(float(fill or 0.0)).alias("value"))
    return a.select(*keys, "idx", "x", "value").unionByName(between).unionByName(tail)


def prepend(a: DataFrame, b: DataFrame, **kw) -> DataFrame:
    return append(b, a, **kw)


def update(a: DataFrame, b: DataFrame, *, dx: float, size: int, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """A rolling buffer of fixed size: append, then keep the last ``size`` samples."""
    full = append(a, b, dx=dx, keys=keys, **kw)
    last = F.max("idx").over(Window.partitionBy(*[F.col(k) for k in keys]))
    return full.withColumn("__drop", last - size + 1).where(F.col("idx") >= F.col("__drop")).withColumn("idx", F.col("idx") - F.greatest("__drop", F.lit(0))).drop("__drop")


def regrid(df: DataFrame, *, time: str, value: Column, step: float, start: float, end: float, fill: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """A regular series from irregular rows: ``value`` aggregated in steps, ``fill`` in empty ones."""
    n = math.ceil((end - start) / step)
    idx = F.floor((F.col(time) - start) / step).cast("long")
    got = df.where((F.col(time) >= start) & (F.col(time) < end)).groupBy(*keys, idx.alias("idx")).agg(value.alias("value"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("idx"))
    return grid.join(got, [*keys, "idx"], "left").select(*keys, "idx", (F.lit(float(start)) + F.col("idx") * step).alias("x"), F.coalesce(F.col("value").cast("double"), F.lit(float(fill))).alias("value"))


def contiguous_pieces(pieces: DataFrame, keys: Sequence[str] = KEYS, *, start: str = "start", end: str = "end", tolerance: float = TOLERANCE) -> DataFrame:
    """Pieces with the number of the run of contiguous pieces that they belong to."""
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(start, end)
    new = F.when(F.abs(F.col(start) - F.lag(end).over(w)) < tolerance, 0).otherwise(1)
    return pieces.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def is_contiguous(a_end: Column, b_start: Column, tolerance: float = TOLERANCE) -> Column:
    """1 if b follows a at once, else 0."""
    return F.when(F.abs(b_start - a_end) < tolerance, 1).otherwise(0)


def inject(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``a`` with the values of ``b`` added where both have a sample."""
    return a.join(b.select(*keys, "idx", F.col("value").alias("__b")), [*keys, "idx"], "left").withColumn("value", F.col("value") + F.coalesce("__b", F.lit(0.0))).select(*keys, "idx", "x", "value")


def _strides(df: DataFrame, n: int, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Aggregates of whole strides of n samples; a trailing part is dropped."""
    out = df.groupBy(*keys, F.floor(F.col("idx") / n).cast("long").alias("step")).agg(F.count("*").alias("__n"), F.min("x").alias("x"), *[c.alias(k) for k, c in aggs.items()])
    return out.where(F.col("__n") == n).drop("__n")


def rms(df: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., step, x, value): the root mean square of each n samples."""
    return _strides(df, n, keys, value=F.sqrt(F.avg(F.col("value") * F.col("value"))))


def heterodyne(df: DataFrame, phase: Column, n: int, *, singlesided: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., step, x, re, im): the mean of value * exp(-i phase) over each n samples, doubled if single-sided."""
    k = 2.0 if singlesided else 1.0
    return _strides(df, n, keys, re=k * F.avg(F.col("value") * F.cos(phase)), im=-k * F.avg(F.col("value") * F.sin(phase)))


def demodulate(df: DataFrame, f: float, n: int, *, dx: float = 1.0, degrees: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., step, x, mag, phase) of the line at frequency f."""
    out = heterodyne(df, F.col("idx") * (2 * math.pi * f * dx), n, singlesided=True, keys=keys)
    angle = F.atan2("im", "re")
    return out.select(*keys, "step", "x", F.hypot("re", "im").alias("mag"), (F.degrees(angle) if degrees else angle).alias("phase"))


def detrend(df: DataFrame, how: str = "constant", keys: Sequence[str] = KEYS) -> DataFrame:
    """Without the mean, or without the least-squares line over idx."""
    w = Window.partitionBy(*[F.col(k) for k in keys])
    mean = F.avg("value").over(w)
    if how == "constant":
        return df.withColumn("value", F.col("value") - mean)
    i = F.col("idx").cast("double")
    slope = F.covar_pop(i, F.col("value")).over(w) / F.var_pop(i).over(w)
    return df.withColumn("value", F.col("value") - mean - F.coalesce(slope, F.lit(0.0)) * (i - F.avg(i).over(w)))


def taper_weight(i: Column, n: Column, left: int, right: int) -> Column:
    """Raised-cosine weight of sample i of n with edges of ``left`` and ``right`` samples, both of the shape of the larger."""
    m = max(left, right)
    edge = lambda k: 0.5 * (1 - F.cos(2 * math.pi * k / (2 * m - 1)))
    out = F.lit(1.0)
    if left:
        out = out * F.when(i < left, edge(i)).otherwise(1.0)
    if right:
        out = out * F.when(n - 1 - i < right, edge(n - 1 - i)).otherwise(1.0)
    return out


def taper(df: DataFrame, left: int = 0, right: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*[F.col(k) for k in keys]))
    return df.withColumn("value", F.col("value") * taper_weight(F.col("idx"), n, left, right))


def auto_taper(df: DataFrame, keys: Sequence[str] = KEYS, side: str = "leftright") -> DataFrame:
    """Tapered from each end up to its second stationary point (beyond a maximum and a minimum), at most half of the series; half where there is none."""
    w, whole = _w(keys), Window.partitionBy(*[F.col(k) for k in keys])
    v = F.col("value")
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    turn = df.withColumns({"__n": F.count("*").over(whole), "__top": F.when((v > before) & (v > after), F.col("idx")), "__low": F.when((v < before) & (v < after), F.col("idx"))})
    half = F.floor(F.col("__n") / 2)
    # greatest and least would pass over a missing kind of point
    both = F.max("__top").over(whole).isNotNull() & F.max("__low").over(whole).isNotNull()
    first = F.greatest(F.min("__top").over(whole), F.min("__low").over(whole))
    last = F.least(F.max("__top").over(whole), F.max("__low").over(whole))
    left = F.when(both, F.least(first, half)).otherwise(half) if "left" in side else F.lit(0)
    right = F.when(both, F.least(F.col("__n") - last, half)).otherwise(half) if "right" in side else F.lit(0)
    rows = turn.withColumns({"__l": left, "__r": right})
    m = F.greatest("__l", "__r")
    edge = lambda k: 0.5 * (1 - F.cos(2 * math.pi * k / (2 * m - 1)))
    back = F.col("__n") - 1 - F.col("idx")
    weight = F.when(F.col("idx") < F.col("__l"), edge(F.col("idx"))).otherwise(1.0) * F.when(back < F.col("__r"), edge(back)).otherwise(1.0)
    return rows.withColumn("value", v * weight).select(*keys, "idx", "x", "value")


def mask(df: DataFrame, dead: DataFrame, *, dx: float, const: float | None = None, taper_samples: int = 0, width: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Samples in ``dead`` segments (start, end; coalesced) set to ``const`` (NaN by default), live edges next to them tapered.

    The distance to the nearest dead sample on either side comes from one window
    pass over the samples, so the taper needs no join of its own.
    """
    from tidegauge.operators.segments import _bucketed

    b = _bucketed(dead, width, (), "start", "end")
    near = df.join(b, (F.floor(F.col("x") / width) == F.col("__bucket")) & (F.col("x") >= F.col("__start")) & (F.col("x") < F.col("__end")), "left")
    rows = near.select(*keys, "idx", "x", "value", F.col("__start").isNotNull().alias("__dead"))
    value = F.when(F.col("__dead"), F.lit(float("nan") if const is None else float(const)))
    if not taper_samples:
        return rows.select(*keys, "idx", "x", value.otherwise(F.col("value")).alias("value"))
    w = _w(keys)
    before = F.last(F.when(F.col("__dead"), F.col("idx")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(F.col("__dead"), F.col("idx")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    ends = Window.partitionBy(*[F.col(k) for k in keys])
    rows = rows.withColumns({"__b": before, "__a": after, "__lo": F.min("idx").over(ends), "__hi": F.max("idx").over(ends)})
    live = F.coalesce("__a", F.col("__hi") + 1) - F.coalesce("__b", F.col("__lo") - 1) - 1
    half = F.least(F.lit(taper_samples), F.floor(live / 2))
    edge = lambda k: 0.5 * (1 - F.cos(2 * math.pi * k / (2 * taper_samples - 1)))
    i, j = F.col("idx") - F.col("__b") - 1, F.col("__a") - F.col("idx") - 1
    weight = F.when(F.col("__b").isNotNull() & (i < half), edge(i)).otherwise(1.0) * F.when(F.col("__a").isNotNull() & (j < half), edge(j)).otherwise(1.0)
    return rows.select(*keys, "idx", "x", value.otherwise(F.col("value") * weight).alias("value"))


def runs(df: DataFrame, *, dx: float = 1.0, least: int = 1, keys: Sequence[str] = KEYS, flag: Column | None = None) -> DataFrame:
    """(keys..., start, end) of the runs of at least ``least`` true samples."""
    true = df.where(flag if flag is not None else F.col("value"))
    island = F.col("idx") - F.row_number().over(_w(keys))
    out = true.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min("x").alias("start"), (F.max("x") + dx).alias("end"), F.count("*").alias("__n"))
    return out.where(F.col("__n") >= least).select(*keys, "start", "end")


def to_flag(df: DataFrame, *, dx: float = 1.0, least: int = 1, outwards: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """The flag of a boolean series: known is its span, active its runs."""
    from tidegauge.operators.segments import as_flags, flag_round

    known = df.groupBy(*keys).agg(F.min("x").alias("start"), (F.max("x") + dx).alias("end"))
    out = as_flags(known, runs(df, dx=dx, least=least, keys=keys), keys)
    return flag_round(out, keys) if outwards else out


def bit_series(df: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., bit, idx, x, value boolean) of the lowest n bits."""
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(F.col("value"), i) == 1))
    return df.select(*keys, "idx", "x", each.alias("bit", "value"))


def bits_resample(df: DataFrame, factor: int, n: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bit vectors at a lower rate: the AND of each ``factor`` samples, of the lowest n bits if given; a trailing part is dropped."""
    v = F.col("value") if n is None else F.col("value").bitwiseAND(F.lit((1 << n) - 1))
    out = df.groupBy(*keys, F.floor(F.col("idx") / factor).cast("long").alias("step")).agg(F.count("*").alias("__n"), F.min("x").alias("x"), F.bit_and(v).alias("value"))
    return out.where(F.col("__n") == factor).drop("__n")


def interpolate(df: DataFrame, step: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Linear interpolation onto the multiples of ``step`` from the first x, up to the last."""
    w = _w(keys)
    rows = df.withColumns({"__x1": F.lead("x").over(w), "__v1": F.lead("value").over(w), "__x0": F.min("x").over(Window.partitionBy(*[F.col(k) for k in keys]))})
    lo, hi = F.ceil((F.col("x") - F.col("__x0")) / step), F.when(F.col("__x1").isNull(), F.floor((F.col("x") - F.col("__x0")) / step)).otherwise(F.ceil((F.col("__x1") - F.col("__x0")) / step) - 1)
    rows = rows.where(hi >= lo).withColumn("__i", F.explode(F.sequence(lo, hi)))
    at = F.col("__x0") + F.col("__i") * step
    value = F.when(F.col("__x1").isNull(), F.col("value")).otherwise(F.col("value") + (F.col("__v1") - F.col("value")) * (at - F.col("x")) / (F.col("__x1") - F.col("x")))
    return rows.select(*keys, F.col("__i").cast("long").alias("idx"), at.alias("x"), value.alias("value"))


def chunks(size: int, stride: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end samples of overlapping chunks: the first step is shorter by half the overlap, the last chunk ends with the data."""
    length = stride + overlap
    out, step = [], 0
    for i in range(max(1, size // stride)):
        start = 0 if i == 0 else step
        end = start + length
        if end > size:
            end = size
            start = max(0, size - length)
        out.append((start, end))
        step = (stride - overlap // 2) if i == 0 else step + stride
    return out


def pad_to(df: DataFrame, start: float, end: float, *, dx: float, fill: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Extended to [start, end) with ``fill`` (whole samples, truncated), or an error for a series that does not cover it if ``fill`` is None."""
    ends = df.groupBy(*keys).agg(F.min("x").alias("__x0"), (F.max("x") + dx).alias("__x1"), F.min("idx").alias("__i0"), F.max("idx").alias("__i1"))
    before, after = ((F.col("__x0") - start) / dx).cast("long"), ((F.lit(float(end)) - F.col("__x1")) / dx).cast("long")
    ends = ends.withColumns({"__b": F.greatest(before, F.lit(0)), "__a": F.greatest(after, F.lit(0))})
    if fill is None:
        short = (F.col("__x0") > start + TOLERANCE) | (F.col("__x1") < end - TOLERANCE)
        ok = ends.select(*keys, F.when(short, F.raise_error(F.lit("the series does not cover the stretch that was asked for")).cast("boolean")).otherwise(F.lit(True)).alias("__ok"))
        return df.join(ok, list(keys)).where("__ok").drop("__ok")
    lead = F.when(F.col("__b") > 0, F.sequence(F.col("__i0") - F.col("__b"), F.col("__i0") - 1)).otherwise(F.array().cast("array<bigint>"))
    tail = F.when(F.col("__a") > 0, F.sequence(F.col("__i1") + 1, F.col("__i1") + F.col("__a"))).otherwise(F.array().cast("array<bigint>"))
    new = ends.select(*keys, "__x0", "__i0", F.explode(F.concat(lead, tail)).alias("idx")).select(*keys, "idx", (F.col("__x0") + (F.col("idx") - F.col("__i0")) * dx).alias("x"), F.lit(float(fill)).alias("value"))
    rows = df.select(*keys, "idx", "x", "value").unionByName(new)
    return rows.join(ends.select(*keys, (F.col("__b") - F.col("__i0")).alias("__s")), list(keys)).withColumn("idx", F.col("idx") + F.col("__s")).drop("__s")


def join_pieces(pieces: DataFrame, *, dx: float, gap: str | None = None, fill: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pieces (keys..., piece, idx, x, value) of a channel in one, by start, with the gap policies of ``append``; any number of pieces in one pass."""
    gap = gap or ("raise" if fill is None else "pad")
    spans = pieces.groupBy(*keys, "piece").agg(F.min("x").alias("__x0"), F.max("x").alias("__x1"), F.count("*").alias("__n"), F.min("idx").alias("__i0"))
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("__x0", "piece")
    hole = F.coalesce(F.col("__x0") - (F.lag("__x1").over(w) + dx), F.lit(0.0))
    spans = spans.withColumn("__gap", hole)
    if gap == "ignore":
        count = F.lit(0).cast("long")
    else:
        wrong = F.abs("__gap") >= TOLERANCE if gap == "raise" else F.col("__gap") <= -TOLERANCE
        count = F.when(wrong, F.raise_error(F.lit("cannot join the pieces: there is a gap or an overlap")).cast("long")).otherwise(F.floor(F.col("__gap") / dx + 0.5))
    spans = spans.withColumn("__pad", count)
    offset = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("__pad").over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = spans.withColumns({"__o": offset, "__first": F.min("__x0").over(Window.partitionBy(*[F.col(k) for k in keys]))})
    idx = F.col("idx") - F.col("__i0") + F.col("__o")
    x = F.col("__first") + idx * dx if gap == "ignore" else F.col("x")
    out = pieces.join(spans, [*keys, "piece"]).select(*keys, idx.alias("idx"), x.alias("x"), "value")
    new = spans.where("__pad > 0").select(*keys, "__x0", "__o", F.explode(F.sequence(F.col("__o") - F.col("__pad"), F.col("__o") - 1)).alias("idx"))
    return out.unionByName(new.select(*keys, "idx", (F.col("__x0") - (F.col("__o") - F.col("idx")) * dx).alias("x"), F.lit(float(fill or 0.0)).alias("value")))


def span(df: DataFrame, *, dx: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., start, end) of the samples; of all channels without keys."""
    return df.groupBy(*keys).agg(F.min("x").alias("start"), (F.max("x") + dx).alias("end"))


def scale(value: Column, slope: Column, offset: Column) -> Column:
    """Raw samples in physical units."""
    return value * slope + offset


def min_mean_max(df: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., step, x, low, mean, high) of each n samples: a line with its band."""
    return df.groupBy(*keys, F.floor(F.col("idx") / n).cast("long").alias("step")).agg(F.min("x").alias("x"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.max("value").alias("high"))


def compatible(a: dict, b: dict) -> None:
    """Whether two series may be combined: equal step and unit; an error says what differs."""
    for what in ("dx", "unit"):
        if a.get(what) != b.get(what):
            raise ValueError(f"the series have different values of {what}: {a.get(what)!r} and {b.get(what)!r}")
