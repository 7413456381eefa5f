"""Half-open segments as rows (keys..., start, end), and the algebra of flags.

Set operations are one sweep: each boundary is a row with the change of depth of
either operand, a window by key sums the depths, and stretches between
neighbouring boundaries are kept by a condition on the two depths. One shuffle
serves all keys. Operands need not be coalesced; results are.

A flag is rows (flag, kind, start, end) with kind "known" or "active".
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("flag",)


def _by(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def _islands(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    w = Window.partitionBy(*_by(keys)).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    df = df.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).select(*keys, start, end)


def coalesce(df: DataFrame, keys: Sequence[str] = (), *, start: str = "start", end: str = "end", coarse: float | None = None) -> DataFrame:
    """Merge overlapping and touching segments by key; segments without length vanish.

    ``coarse`` is a stretch of the axis: segments are first coalesced within the
    stretch that their start lies in, so that without keys only the islands of
    the stretches, not all segments, meet in one task.
    """
    df = df.where(F.col(start) < F.col(end)).select(*keys, start, end)
    if coarse:
        df = _islands(df.withColumn("__part", F.floor(F.col(start) / coarse)), [*keys, "__part"], start, end).drop("__part")
    return _islands(df, keys, start, end)


def _cut(df: DataFrame, coarse: float, start: str, end: str) -> DataFrame:
    """Segments cut at the borders of stretches, with the number of the stretch."""
    parts = F.sequence(F.floor(F.col(start) / coarse), F.ceil(F.col(end) / coarse) - 1)
    df = df.withColumn("__part", F.explode(parts))
    return df.withColumns({start: F.greatest(F.col(start), (F.col("__part") * coarse).cast("double")), end: F.least(F.col(end), ((F.col("__part") + 1) * coarse).cast("double"))})


def sweep(frames: dict[str, DataFrame], keep: Callable[[dict[str, Column]], Column], keys: Sequence[str] = (), *, start: str = "start", end: str = "end", coarse: float | None = None) -> DataFrame:
    """Stretches where ``keep`` holds of the depths of the named frames; coalesced.

    With ``coarse``, segments are cut at multiples of it and swept apart, so that
    a key with many boundaries is no single task; what was cut is joined again.
    """
    names = list(frames)
    by = [*keys, *["__part"] * bool(coarse)]
    rows = None
    for name, df in frames.items():
        df = df.where(F.col(start) < F.col(end))
        df = _cut(df, coarse, start, end) if coarse else df
        step = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d"))))
        part = df.select(*by, step.alias("e")).select(*by, F.col("e.t").alias("t"), *[(F.col("e.d") if n == name else F.lit(0)).alias(f"__{n}") for n in names])
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.groupBy(*by, "t").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in names])
    w = Window.partitionBy(*_by(by)).orderBy("t")
    rows = rows.withColumns({f"__{n}": F.sum(f"__{n}").over(w) for n in names} | {"__to": F.lead("t").over(w)})
    rows = rows.where(F.col("__to").isNotNull() & keep({n: F.col(f"__{n}") for n in names}))
    rows = _islands(rows.select(*by, F.col("t").alias(start), F.col("__to").alias(end)), by, start, end)
    return _islands(rows.drop("__part"), keys, start, end) if coarse else rows


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), *, start: str = "start", end: str = "end", coarse: float | None = None) -> DataFrame:
    return coalesce(a.select(*keys, start, end).unionByName(b.select(*keys, start, end)), keys, start=start, end=end, coarse=coarse)


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), **kw) -> DataFrame:
    return sweep({"a": a, "b": b}, lambda d: (d["a"] > 0) & (d["b"] > 0), keys, **kw)


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), **kw) -> DataFrame:
    return sweep({"a": a, "b": b}, lambda d: (d["a"] > 0) & (d["b"] <= 0), keys, **kw)


def symmetric_difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), **kw) -> DataFrame:
    return sweep({"a": a, "b": b}, lambda d: (d["a"] > 0) != (d["b"] > 0), keys, **kw)


def contract(df: DataFrame, by: float, keys: Sequence[str] = (), **cols: str) -> DataFrame:
    """Shrink every coalesced segment by ``by`` at both ends; what has no length left vanishes. A negative ``by`` grows them."""
    s, e = cols.get("start", "start"), cols.get("end", "end")
    return coalesce(coalesce(df, keys, **cols).withColumns({s: F.col(s) + by, e: F.col(e) - by}), keys, **cols)


def protract(df: DataFrame, by: float, keys: Sequence[str] = (), **cols: str) -> DataFrame:
    return contract(df, -by, keys, **cols)


def shift(df: DataFrame, by: float, *, start: str = "start", end: str = "end") -> DataFrame:
    return df.withColumns({start: F.col(start) + by, end: F.col(end) + by})


def extent(df: DataFrame, keys: Sequence[str] = (), *, start: str = "start", end: str = "end") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end))


def livetime(df: DataFrame, keys: Sequence[str] = (), *, start: str = "start", end: str = "end") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("livetime"))


def to_table(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., index, start, end, duration), the index by start within a key."""
    return df.select(*keys, (F.row_number().over(Window.partitionBy(*_by(keys)).orderBy("start", "end")) - 1).alias("index"), "start", "end", (F.col("end") - F.col("start")).alias("duration"))


def kind(flags: DataFrame, which: str) -> DataFrame:
    return flags.where(F.col("kind") == which).drop("kind")


def as_flags(known: DataFrame, active: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    cols = [*keys, "kind", "start", "end"]
    return known.withColumn("kind", F.lit("known")).select(cols).unionByName(active.withColumn("kind", F.lit("active")).select(cols))


def flag_and(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return as_flags(*[intersection(kind(a, k), kind(b, k), keys) for k in ("known", "active")], keys)


def flag_or(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return as_flags(*[union(kind(a, k), kind(b, k), keys) for k in ("known", "active")], keys)


def flag_sub(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Active of a and not of b, within what both know."""
    frames = {"a": kind(a, "active"), "b": kind(b, "active"), "ka": kind(a, "known"), "kb": kind(b, "known")}
    active = sweep(frames, lambda d: (d["a"] > 0) & (d["b"] <= 0) & (d["ka"] > 0) & (d["kb"] > 0), keys)
    return as_flags(intersection(kind(a, "known"), kind(b, "known"), keys), active, keys)


def flag_xor(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Active of either but not both (not cut to what is known); known by both."""
    return as_flags(intersection(kind(a, "known"), kind(b, "known"), keys), symmetric_difference(kind(a, "active"), kind(b, "active"), keys), keys)


def flag_invert(a: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Known and not active; known stays."""
    return as_flags(coalesce(kind(a, "known"), keys), difference(kind(a, "known"), kind(a, "active"), keys), keys)


def flag_coalesce(a: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both kinds coalesced, active cut to known."""
    return as_flags(coalesce(kind(a, "known"), keys), intersection(kind(a, "known"), kind(a, "active"), keys), keys)


def flag_pad(a: DataFrame, before: float, after: float) -> DataFrame:
    """``before`` added to all starts and ``after`` to all ends, of both kinds; nothing is merged."""
    return a.withColumns({"start": F.col("start") + before, "end": F.col("end") + after})


def flag_round(a: DataFrame, keys: Sequence[str] = KEYS, *, inwards: bool = False) -> DataFrame:
    """Bounds on whole numbers, outwards or inwards, both kinds; coalesced, active cut to known."""
    lo, hi = (F.ceil, F.floor) if inwards else (F.floor, F.ceil)
    return flag_coalesce(a.withColumns({"start": lo("start").cast("double"), "end": hi("end").cast("double")}), keys)


def flag_contract(a: DataFrame, by: float, keys: Sequence[str] = KEYS) -> DataFrame:
    return as_flags(kind(a, "known"), contract(kind(a, "active"), by, keys), keys)


def flag_protract(a: DataFrame, by: float, keys: Sequence[str] = KEYS) -> DataFrame:
    return flag_contract(a, -by, keys)


def flag_regular(a: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., regular): whether all that is active is known."""
    outside = difference(kind(a, "active"), kind(a, "known"), keys).select(*keys).distinct().withColumn("__out", F.lit(True))
    return a.select(*keys).distinct().join(outside, list(keys), "left").select(*keys, F.col("__out").isNull().alias("regular"))


def flag_populate(flags: DataFrame, source: DataFrame, padding: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Known cut to the source's; active from the source, padded (keys..., before, after) if asked for, cut to known."""
    known = intersection(kind(flags, "known"), kind(source, "known"), keys)
    active = kind(source, "active")
    if padding is not None:
        active = active.join(padding, list(keys), "left").select(*keys, (F.col("start") + F.coalesce("before", F.lit(0.0))).alias("start"), (F.col("end") + F.coalesce("after", F.lit(0.0))).alias("end"))
    return as_flags(known, intersection(known, active, keys), keys)


def all_union(flags: DataFrame) -> DataFrame:
    """(kind, start, end) of the OR of all flags."""
    return coalesce(flags, ["kind"])


def all_intersection(flags: DataFrame, key: str = "flag") -> DataFrame:
    """(kind, start, end) of the AND of all flags: where the depth of the coalesced flags is their number."""
    single = coalesce(flags, [key, "kind"])
    many = flags.agg(F.countDistinct(key).alias("n"))
    step = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d"))))
    rows = single.select("kind", step.alias("e")).groupBy("kind", F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("kind").orderBy("t")
    rows = rows.withColumns({"d": F.sum("d").over(w), "to": F.lead("t").over(w)}).join(F.broadcast(many), F.col("d") == F.col("n"))
    return _islands(rows.select("kind", F.col("t").alias("start"), F.col("to").alias("end")), ["kind"], "start", "end")


def dict_and(base: DataFrame, other: DataFrame) -> DataFrame:
    """Shared flags intersect; flags of ``other`` alone become empty (no rows); flags of ``base`` alone stay."""
    shared = base.select("flag").distinct().join(other.select("flag").distinct(), "flag", "left_semi")
    own = base.join(other.select("flag").distinct(), "flag", "left_anti").select("flag", "kind", "start", "end")
    return flag_and(base.join(shared, "flag", "left_semi"), other.join(shared, "flag", "left_semi")).unionByName(own)


def dict_or(base: DataFrame, other: DataFrame) -> DataFrame:
    """Shared flags unite; the others are copied."""
    a, b = base.select("flag").distinct(), other.select("flag").distinct()
    alone = base.join(b, "flag", "left_anti").unionByName(other.join(a, "flag", "left_anti")).select("flag", "kind", "start", "end")
    return flag_or(base.join(b, "flag", "left_semi"), other.join(a, "flag", "left_semi")).unionByName(alone)


def dict_sub(base: DataFrame, other: DataFrame) -> DataFrame:
    """Difference of shared flags; flags of ``base`` alone stay."""
    b = other.select("flag").distinct()
    return flag_sub(base.join(b, "flag", "left_semi"), other).unionByName(base.join(b, "flag", "left_anti").select("flag", "kind", "start", "end"))


def dict_xor(base: DataFrame, other: DataFrame) -> DataFrame:
    """Symmetric difference of shared flags; flags of ``base`` alone stay."""
    a, b = base.select("flag").distinct(), other.select("flag").distinct()
    return flag_xor(base.join(b, "flag", "left_semi"), other.join(a, "flag", "left_semi")).unionByName(base.join(b, "flag", "left_anti").select("flag", "kind", "start", "end"))


def from_veto_definers(definers: DataFrame, start: float, end: float, ifo: str | None = None) -> DataFrame:
    """Known segments (flag, start, end) of veto definers (ifo, name, version, start_time, end_time, ...) that overlap a range, cut to it; an end of 0 or null is open."""
    upper = F.coalesce(F.nullif(F.col("end_time"), F.lit(0)).cast("double"), F.lit(float("inf")))
    rows = definers if ifo is None else definers.where(F.col("ifo") == ifo)
    rows = rows.where((F.col("start_time") < end) & (upper > start))
    flag = F.concat_ws(":", "ifo", "name", F.col("version").cast("string"))
    return coalesce(rows.select(flag.alias("flag"), F.greatest(F.col("start_time").cast("double"), F.lit(float(start))).alias("start"), F.least(upper, F.lit(float(end))).alias("end")), ["flag"])


def from_segment_tables(definers: DataFrame, summaries: DataFrame, segments: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Flags of the three-table form: definer joined with summary gives known, with segment active."""
    flag = F.concat_ws(":", F.col("ifos"), F.col("name"), F.col("version").cast("string"))
    names_of = definers.select("segment_def_id", flag.alias("flag"))
    if names is not None:
        names_of = names_of.where(F.col("flag").isin(list(names)))
    known = names_of.join(summaries, "segment_def_id").select("flag", F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    active = names_of.join(segments, "segment_def_id").select("flag", F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    return as_flags(known, active)


def to_segment_tables(flags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Definer, summary and segment tables of flags IFO:TAG:VERSION; ids follow the order of names and starts."""
    from tidegauge.functions.names import flag_part

    name = F.col("flag")
    ids = flags.select("flag").distinct().withColumn("segment_def_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("flag")) - 1)  # one row for each flag
    definers = ids.select("segment_def_id", flag_part(name, "ifo").alias("ifos"), flag_part(name, "tag").alias("name"), flag_part(name, "version").alias("version"))

    def rows(which: str, ident: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("segment_def_id").orderBy("start", "end")) - 1
        return kind(flags, which).join(ids, "flag").select(nth.alias(ident), "segment_def_id", F.col("start").alias("start_time"), F.col("end").alias("end_time"))

    return definers, rows("known", "segment_sum_id"), rows("active", "segment_id")


def _bucketed(segments: DataFrame, width: float, keys: Sequence[str], start: str, end: str) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.ceil(F.col(end) / width) - 1
    return segments.where(F.col(start) < F.col(end)).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(start).alias("__start"), F.col(end).alias("__end"), F.explode(F.sequence(first, F.greatest(first, last))).alias("__bucket"))


def _member(df: DataFrame, segments: DataFrame, column: str, width: float, keys: Sequence[str], how: str, start: str, end: str) -> DataFrame:
    b = _bucketed(segments, width, keys, start, end)
    on = (F.floor(F.col(column) / width) == F.col("__bucket")) & (F.col("__start") <= F.col(column)) & (F.col(column) < F.col("__end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return df.join(b, on, how)


def in_segments(df: DataFrame, segments: DataFrame, column: str, *, width: float, keys: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose ``column`` lies in a segment [start, end).

    An equi-join on stretches of ``width`` with the exact condition on top, so
    that no plan compares all rows with all segments; choose ``width`` near the
    median length of a segment.
    """
    return _member(df, segments, column, width, keys, "left_semi", start, end)


def not_in_segments(df: DataFrame, segments: DataFrame, column: str, *, width: float, keys: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose ``column`` lies in no segment."""
    return _member(df, segments, column, width, keys, "left_anti", start, end)


#: With so many copies of a segment on average, ``overlap_join`` joins distinct segments; with fewer, counting them costs more shuffle than it saves.
COPIES = 3


def overlap_join(a: DataFrame, b: DataFrame, *, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of overlapping segments (keys..., a_start, a_end, b_start, b_end), each pair in the first stretch that both touch.

    The share of distinct segments of either side is estimated first. Where it
    is small, equal segments meet as one with their number; the pairs of their
    copies are made behind the join, next to each other, where columnar files
    hold them as runs. Otherwise a side is shuffled once, for the join.
    """
    counted = []

    def side(df: DataFrame, name: str) -> DataFrame:
        same = [*keys, "start", "end"]
        rows, distinct = df.where(F.col("start") < F.col("end")).agg(F.count("*"), F.approx_count_distinct(F.struct(*same))).first()
        renamed = {"__start": f"{name}_start", "__end": f"{name}_end"}
        if rows < COPIES * distinct:
            return _bucketed(df, width, keys, "start", "end").withColumnsRenamed(renamed)
        counted.append(f"__{name}")
        copies = df.groupBy(*same).agg(F.count("*").alias("n"))
        return _bucketed(copies, width, [*keys, "n"], "start", "end").withColumnsRenamed(renamed | {"__n": f"__{name}"})

    both = side(a, "a").join(side(b, "b"), [*[f"__{k}" for k in keys], "__bucket"])
    first = F.floor(F.greatest("a_start", "b_start") / width) == F.col("__bucket")
    out = both.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & first)
    for n in counted:
        out = out.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    return out.select(*[F.col(f"__{k}").alias(k) for k in keys], "a_start", "a_end", "b_start", "b_end")
