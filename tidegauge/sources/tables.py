"""Event tables in commented text, and joins of trigger tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.derived import with_derived
from tidegauge.sources.registry import merge, register


def read_commented(spark: SparkSession, paths: Sequence[str], *, comment: str = "#", names: Sequence[str] | None = None) -> DataFrame:
    """A table of numbers and words whose comment lines name the columns: one name a line (the word before any unit or number), or all in the last comment line."""
    m = F.col("_metadata")
    lines = spark.read.text(list(paths)).select(F.trim("value").alias("line"), m["file_path"].alias("file"), m["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"))
    if names is None:
        comments = lines.where(F.col("line").startswith(comment)).orderBy("file", "start", "at")
        head = [r.line.lstrip(comment).strip() for r in comments.limit(1000).collect()]  # the header of the file
        one = [h.split()[0].rstrip(":") for h in head if h and re.fullmatch(r"[\w.%-]+:?(\s+[\[(].*)?", h)]
        names = one if len(one) > 1 else head[-1].split() if head else None
    if not names:
        raise ValueError("the file names no columns")
    p = lines.where(~F.col("line").startswith(comment) & (F.col("line") != "")).select(F.split("line", r"\s+").alias("p"))
    first = p.first()
    kinds = ["double" if first is None or re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|nan|inf", v.lower()) else "string" for v in (first.p if first else names)]
    return p.select(*[F.get("p", F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=False))])


register("ascii.cwb", read=lambda s, p, **o: read_commented(s, p, comment="#", **o))
register("ascii.omega", read=lambda s, p, **o: read_commented(s, p, comment="%", **o))


def single_triggers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Triggers of one detector with the named columns, stored or derived."""
    return with_derived(df, list(columns)) if columns else df


def coincident_triggers(inspiral: DataFrame, events: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The two tables of coincident triggers joined on their id; the id goes unless it is named."""
    both = inspiral.join(events, "coinc_event_id")
    return both.drop("coinc_event_id") if columns is None else both.select(*columns)


def stack_channels(frames: dict[str, DataFrame], *, compact: bool = False) -> DataFrame:
    """Tables of channels with equal columns in one, with the channel's name, or its 64-bit hash."""
    tag = lambda n: F.xxhash64(F.lit(n)) if compact else F.lit(n)
    return merge([f.withColumn("channel", tag(n)) for n, f in frames.items()], "exact")


def loudest(df: DataFrame, index: DataFrame, position: str = "idx") -> DataFrame:
    """The rows at the listed positions."""
    return df.join(index.select(F.col(position)), position, "left_semi")


def months(start: str, end: str, spark: SparkSession, prefix: str = "geo") -> DataFrame:
    """(name): the monthly databases from one time to another."""
    return spark.range(1).select(F.explode(F.sequence(F.trunc(F.to_date(F.lit(start)), "month"), F.to_date(F.lit(end)), F.expr("interval 1 month"))).alias("m")).select(F.concat(F.lit(prefix), F.date_format("m", "yyyyMM")).alias("name"))


def process_triggers(triggers: DataFrame, processes: DataFrame, start: float, end: float, *, channel: str | None = None, monitor: str | None = None) -> DataFrame:
    """Triggers of the processes that overlap a range, cut to both, with the derived time, by start."""
    p = processes.where((F.col("gps_start") < end) & (F.col("gps_stop") > start))
    p = p.where(F.col("channel") == channel) if channel else p
    p = p.where(F.col("monitorName") == monitor) if monitor else p
    p = p.select("process_id", F.greatest("gps_start", F.lit(start)).alias("__s"), F.least("gps_stop", F.lit(end)).alias("__e"))
    out = triggers.join(p, "process_id").where((F.col("gps_start") >= F.col("__s")) & (F.col("gps_start") < F.col("__e"))).drop("__s", "__e")
    return out.withColumn("gpstime", F.col("gps_start") + F.col("gps_offset"))
