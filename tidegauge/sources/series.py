"""Text forms of series and segments, and flags as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.sources.registry import register


def read_txt(spark: SparkSession, paths: Sequence[str], *, sep: str = r"\s+", start: float | None = None, end: float | None = None) -> DataFrame:
    """(file, idx, x, value) of text of two or more columns, and ``values`` of all but the first; lines that start with # are passed over."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = lines.select("file", F.transform(F.split("line", sep), lambda v: v.cast("double")).alias("p"))
    rows = parts.select("file", F.col("p")[0].alias("x"), F.try_element_at("p", F.lit(2)).alias("value"), F.slice("p", 2, 1 << 20).alias("values"))
    if start is not None:
        rows = rows.where(F.col("x") >= start)
    if end is not None:
        rows = rows.where(F.col("x") < end)
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("file").orderBy("x")).cast("long") - 1)


def write_txt(df: DataFrame, path: str, *, sep: str = "\t", mode: str = "errorifexists") -> None:
    df.select(F.concat_ws(sep, F.col("x").cast("string"), F.col("value").cast("string")).alias("value")).write.mode(mode).text(path)


register("txt", read=read_txt, write=write_txt, extensions=("txt", "dat"))


def read_segwizard(spark: SparkSession, paths: Sequence[str], *, strict: bool = True) -> DataFrame:
    """(start, end) of text segments of two (start, stop), three (and duration) or four (index first) columns; ``strict`` checks the duration."""
    lines = spark.read.text(list(paths)).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#') and not startswith(line, ';')")
    p = lines.select("line", F.transform(F.split("line", r"[\s,]+"), lambda v: v.cast("double")).alias("p")).withColumn("n", F.size("p"))
    at = F.when(F.col("n") == 4, 1).otherwise(0)
    rows = p.select("line", "n", F.get("p", at).alias("start"), F.get("p", at + 1).alias("end"), F.get("p", at + 2).alias("duration"))
    bad = (F.col("n") < 2) | (F.col("n") > 4) | F.col("start").isNull() | F.col("end").isNull()
    if strict:
        bad = bad | ((F.col("n") > 2) & (F.abs(F.col("end") - F.col("start") - F.col("duration")) > 1e-6))
    error = F.raise_error(F.concat(F.lit("not a segment: "), F.col("line"))).cast("double")
    return rows.select(F.when(bad, error).otherwise(F.col("start")).alias("start"), "end")


def write_segwizard(df: DataFrame, path: str, *, header: bool = True, mode: str = "errorifexists") -> None:
    """Index, start, stop and duration, tab-separated, in order; one file."""
    w = Window.partitionBy(F.lit(0)).orderBy("start", "end")  # the format is one ordered list
    rows = df.select((F.row_number().over(w) - 1).alias("i"), "start", "end").select("i", F.concat_ws("\t", "i", "start", "end", F.col("end") - F.col("start")).alias("value"))
    if header:
        rows = rows.unionByName(df.sparkSession.createDataFrame([(-1, "# seg\tstart\tstop\tduration")], "i int, value string"))
    rows.repartition(1).sortWithinPartitions("i").select("value").write.mode(mode).text(path)


register("segwizard", read=read_segwizard, write=write_segwizard, extensions=("seg", "segments"))

FLAG = "name string, ifo string, version int, category string, isgood boolean, known array<array<double>>, active array<array<double>>, metadata map<string,string>"


def read_json_flags(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(flag, kind, start, end) of JSON documents of flags, one a file."""
    docs = spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True).select(F.from_json("value", FLAG).alias("d")).select("d.*")
    ident = F.when(F.col("ifo").isNotNull() & ~F.col("name").startswith(F.concat("ifo", F.lit(":"))), F.concat_ws(":", "ifo", "name", F.col("version").cast("string"))).otherwise(F.col("name"))
    rows = lambda k: F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s[0].alias("start"), s[1].alias("end")))
    each = F.explode(F.concat(rows("known"), rows("active")))
    return docs.select(ident.alias("flag"), each.alias("s")).select("flag", "s.kind", "s.start", "s.end")


def flags_json(flags: DataFrame) -> DataFrame:
    """(flag, value): a JSON document of each flag."""
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end")))), lambda s: F.array(s["start"], s["end"]))
    return flags.groupBy("flag").agg(of("known").alias("known"), of("active").alias("active")).select("flag", F.to_json(F.struct(F.col("flag").alias("name"), "known", "active")).alias("value"))


def write_json_flags(flags: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """A file for each flag, as readers take one document a file."""
    flags_json(flags).select(F.col("flag").alias("file"), "value").write.mode(mode).partitionBy("file").text(path)


register("json.flag", read=read_json_flags, write=write_json_flags, extensions=("flag.json",))
