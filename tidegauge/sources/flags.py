"""Flags in three-table XML documents, queries of flags over stretches, and merges of flag files."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.segments import as_flags, coalesce, flag_coalesce, from_segment_tables, intersection, kind, to_segment_tables
from tidegauge.sources import xml
from tidegauge.sources.registry import merge, register


def check_names(flags: DataFrame, names: Sequence[str], on_missing: str = "error") -> DataFrame:
    """The named flags; missing ones are an error, a warning, or passed over."""
    got = {r.flag for r in flags.where(F.col("flag").isin(list(names))).select("flag").distinct().collect()}  # as many as names
    if missing := [n for n in names if n not in got]:
        if on_missing == "error":
            raise KeyError(f"no flags {missing}")
        if on_missing == "warn":
            warnings.warn(f"no flags {missing}", stacklevel=2)
    return flags.where(F.col("flag").isin(list(names)))


def merge_flags(frames: Sequence[DataFrame], *, names: Sequence[str] | None = None, on_missing: str = "error", merged: bool = False) -> DataFrame:
    """Flags of several files in one, coalesced if ``merged``."""
    out = merge(frames, "exact")
    out = check_names(out, names, on_missing) if names is not None else out
    return flag_coalesce(out) if merged else out


def merge_segments(frames: Sequence[DataFrame], *, merged: bool = False) -> DataFrame:
    out = merge(frames, "exact")
    return coalesce(out, [c for c in out.columns if c not in ("start", "end")]) if merged else out


#: Flags of documents, up to which all executors get their names; more are joined by a shuffle.
MOST_NAMES = 100_000
#: Bytes of documents that a part of the result is read from, so that it isn't written as many small files.
PART = 128 << 20


def read_xml_flags(spark: SparkSession, paths: Sequence[str], *, names: Sequence[str] | None = None, merged: bool = False) -> DataFrame:
    definers, *tables = [xml.read_table(spark, paths, tablename=t) for t in ("segment_definer", "segment_summary", "segment")]
    few = definers.limit(MOST_NAMES + 1).count() <= MOST_NAMES
    if few:
        size = spark.read.format("binaryFile").load(list(paths)).agg(F.sum("length")).first()[0]
        definers, tables = F.broadcast(definers), [t.coalesce(1 + size // PART) for t in tables]
    out = from_segment_tables(definers, *tables, names=names)
    return flag_coalesce(out) if merged else out


def write_xml_flags(flags: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    definers, summaries, segments = to_segment_tables(flags)
    xml.write_document({"segment_definer": definers, "segment_summary": summaries, "segment": segments}, path, mode)


register("ligolw.flag", read=read_xml_flags, write=write_xml_flags)


def query_flags(source: DataFrame, segments: DataFrame, names: Sequence[str] | None = None, on_missing: str = "error") -> DataFrame:
    """Flags of a source, both kinds cut to the stretches (start, end) that were asked for."""
    flags = source if names is None else check_names(source, names, on_missing)
    asked = flags.select("flag").distinct().crossJoin(F.broadcast(coalesce(segments)))  # a row for each flag and stretch asked for
    return as_flags(*[intersection(kind(flags, k), asked, ["flag"]) for k in ("known", "active")])


def find_channels(catalogue: DataFrame, names: Sequence[str], *, rate: float | None = None, kinds: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """Rows of a channel catalogue (name, rate, type) by name pattern (with ``*``), rate and type; ``unique`` wants one for each name."""
    like = F.lit(False)
    for n in names:
        like = like | F.col("name").like(n.replace("%", r"\%").replace("_", r"\_").replace("*", "%"))
    out = catalogue.where(like)
    out = out.where(F.col("rate") == rate) if rate is not None else out
    out = out.where(F.col("type").isin(list(kinds))) if kinds else out
    if unique:
        n = out.groupBy("name").agg(F.count("*").alias("__n"))
        out = out.join(n, "name").where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("several channels called "), "name")).cast("boolean"))).drop("__n")
    return out


def hosts(environment: str, defaults: Sequence[str] = ()) -> list[tuple[str, int | None]]:
    """Servers of a ``host:port,host`` list, then the defaults, each once."""
    out: list[tuple[str, int | None]] = []
    for h in [*filter(None, environment.split(",")), *defaults]:
        name, _, port = h.strip().partition(":")
        if name and all(name != n for n, _ in out):
            out.append((name, int(port) if port else None))
    return out
