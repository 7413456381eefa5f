"""Lists of files whose names hold their stretch of time, OBS-DESC-START-DUR.ext."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.names import file_part
from tidegauge.operators.segments import coalesce, difference
from tidegauge.sources.registry import register


def manifest(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, observatory, description, start, end); the parts of names of another form are null."""
    p = F.col(column)
    start = file_part(p, "start")
    return paths.select(p.alias("path"), file_part(p, "observatory").alias("observatory"), file_part(p, "description").alias("description"), start.alias("start"), (start + file_part(p, "duration")).alias("end"))


def read_cache(spark: SparkSession, paths: Sequence[str], *, segment: tuple[float, float] | None = None, strict: bool = False) -> DataFrame:
    """The manifest of list files: a path a line, or several columns, of which the one shaped like a file name with its stretch of time is the path."""
    lines = spark.read.text(list(paths)).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    p = F.split("line", r"\s+")
    path = F.coalesce(F.get(F.filter(p, lambda x: file_part(x, "start").isNotNull()), F.lit(0)), F.get(p, F.lit(0)))
    out = manifest(lines.select(F.regexp_replace(path, "^file://(localhost)?", "").alias("path")))
    return out if segment is None else sieve(out, *segment, strict=strict)


def write_cache(df: DataFrame, path: str, *, layout: str = "plain", mode: str = "errorifexists") -> None:
    """Paths as ``plain`` lines, or in the layouts ``lal`` (five columns) or ``ffl`` (path, start, duration, 0, 0)."""
    n = lambda c: F.col(c).cast("long").cast("string")
    length = (F.col("end") - F.col("start")).cast("long").cast("string")
    row = {"plain": F.col("path"), "lal": F.concat_ws(" ", "observatory", "description", n("start"), length, F.concat(F.lit("file://localhost"), "path")), "ffl": F.concat_ws(" ", F.col("path"), n("start"), length, F.lit("0"), F.lit("0"))}[layout]
    df.select(row.alias("value")).write.mode(mode).text(path)


register("cache", read=read_cache, write=write_cache, extensions=("lcf", "cache", "ffl"))


def sieve(files: DataFrame, start: float, end: float, *, strict: bool = False) -> DataFrame:
    """Files that overlap [start, end); names of another form are left out, or an error if ``strict``."""
    if strict:
        error = F.raise_error(F.concat(F.lit("not a file name with a stretch of time: "), "path")).cast("double")
        files = files.withColumn("start", F.coalesce("start", error))
    return files.where((F.col("start") < end) & (F.col("end") > start))


def ordered(files: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Sieved and sorted by their stretch."""
    out = files if start is None else sieve(files, start, end)
    return out.orderBy("start", "end", "path")


def coverage(files: DataFrame, keys: Sequence[str] = ("observatory", "description")) -> DataFrame:
    """Coalesced segments that the files cover."""
    return coalesce(files.where("start is not null"), keys)


def contiguous(files: DataFrame, keys: Sequence[str] = ("observatory", "description")) -> DataFrame:
    """Files with the number of the run without gaps that they belong to."""
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("__new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def gaps(files: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("observatory", "description")) -> DataFrame:
    """What of the wanted segments (keys..., start, end) no file covers."""
    return difference(wanted, files.where("start is not null"), keys)


def latest(files: DataFrame, keys: Sequence[str] = ("observatory", "description")) -> DataFrame:
    """(keys..., path): the file that ends last."""
    return files.groupBy(*keys).agg(F.max_by("path", F.struct("end", "start", "path")).alias("path"))


def types(files: DataFrame, match: str | None = None) -> DataFrame:
    """(observatory, description): the kinds of data sets; trends after the others."""
    out = files.select("observatory", "description").distinct()
    if match:
        out = out.where(F.col("description").rlike(match))
    return out.orderBy(F.col("description").endswith("_T") | F.col("description").endswith("_M"), "observatory", "description")


def best_type(files: DataFrame, start: float, end: float, channels: DataFrame | None = None) -> DataFrame:
    """(observatory, description, livetime, gapless), best first: without gaps, then by time covered, then by fewest channels."""
    cover = coverage(files).where((F.col("start") < end) & (F.col("end") > start))
    live = cover.groupBy("observatory", "description").agg(F.sum(F.least("end", F.lit(float(end))) - F.greatest("start", F.lit(float(start)))).alias("livetime"))
    live = live.withColumn("gapless", F.col("livetime") >= end - start)
    if channels is not None:
        live = live.join(channels.groupBy("description").agg(F.count("*").alias("n_channels")), "description", "left")
        return live.orderBy(F.desc("gapless"), F.desc("livetime"), "n_channels", "description")
    return live.orderBy(F.desc("gapless"), F.desc("livetime"), "description")
