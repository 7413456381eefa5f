"""The table of formats, and the one read and write call over it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidegauge.functions import filters


@dataclass
class Format:
    read: Callable[..., DataFrame] | None = None
    write: Callable[..., None] | None = None
    extensions: tuple[str, ...] = ()


FORMATS: dict[str, Format] = {}


def register(name: str, *, read=None, write=None, extensions: Sequence[str] = ()) -> None:
    """Add a format, or parts of one."""
    f = FORMATS.setdefault(name, Format())
    f.read, f.write, f.extensions = read or f.read, write or f.write, tuple(extensions) or f.extensions


def infer_format(path: str | Sequence[str]) -> str:
    """The format of a path by its extension; of several, by the first. Compression suffixes are passed over."""
    first = (path if isinstance(path, str) else path[0]).lower().rstrip("/")
    for suffix in (".gz", ".bz2", ".zst"):
        first = first.removesuffix(suffix)
    for name, f in FORMATS.items():
        if any(first.endswith("." + e) for e in f.extensions):
            return name
    raise ValueError(f"cannot tell the format of {path!r}; name it")


def _spark_reader(name: str, **defaults: Any):
    return lambda spark, paths, **options: spark.read.format(name).options(**(defaults | options)).load(list(paths))


def _spark_writer(name: str, **defaults: Any):
    def write(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = (), **options: Any) -> None:
        df.write.format(name).mode(mode).options(**(defaults | options)).partitionBy(*partition_by).save(path)

    return write


for _name, _ext, _opt in (("parquet", ("parquet", "pq"), {}), ("orc", ("orc",), {}), ("json", ("jsonl", "ndjson"), {}), ("csv", ("csv",), {"header": "true", "inferSchema": "true"})):
    register(_name, read=_spark_reader(_name, **_opt), write=_spark_writer(_name, **({"header": "true"} if _name == "csv" else {})), extensions=_ext)


def merge(frames: Sequence[DataFrame], how: str = "outer") -> DataFrame:
    """Tables stacked: ``outer`` keeps all columns with nulls, ``inner`` the common ones, ``exact`` wants equal columns."""
    out = frames[0]
    for f in frames[1:]:
        if how == "exact" and set(f.columns) != set(out.columns):
            raise ValueError(f"columns differ: {out.columns} and {f.columns}")
        if how == "inner":
            common = [c for c in out.columns if c in f.columns]
            out, f = out.select(common), f.select(common)
        out = out.unionByName(f, allowMissingColumns=how == "outer")
    return out


def read(spark: SparkSession, source: str | Sequence[str], *, format: str | None = None, columns: Sequence[str] | None = None, where: Any = None, merge_function: Callable[[Sequence[DataFrame]], DataFrame] | None = None, **options: Any) -> DataFrame:
    """Read files of any registered format; ``columns`` and ``where`` (the filter language) reach the scan where it takes them.

    Files of one call are one scan; with ``merge_function`` each is a frame of
    its own, and the function joins them.
    """
    from tidegauge.sources import flags, hdf5, manifest, series, tables, wav, xml  # noqa: F401  they register their formats

    paths = [source] if isinstance(source, str) else list(source)
    reader = FORMATS[format or infer_format(paths)].read
    if reader is None:
        raise ValueError(f"{format or infer_format(paths)} cannot be read")
    df = merge_function([reader(spark, [p], **options) for p in paths]) if merge_function else reader(spark, paths, **options)
    if where is not None:
        df = filters.where(df, where)
    if columns is not None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"no columns {missing}; there are {df.columns}")
        df = df.select(*columns)
    return df


def write(df: DataFrame, path: str, *, format: str | None = None, **options: Any) -> None:
    from tidegauge.sources import flags, hdf5, manifest, series, tables, wav, xml  # noqa: F401

    writer = FORMATS[format or infer_format(path)].write
    if writer is None:
        raise ValueError(f"{format or infer_format(path)} cannot be written")
    writer(df, path, **options)


@dataclass
class Source:
    """A place that data can be fetched from; lower priority is tried first."""

    name: str
    get: Callable[..., DataFrame]
    priority: int = 10


def ranked(sources: Sequence[Source], only: str | Sequence[str] | None = None) -> list[Source]:
    names = [only] if isinstance(only, str) else only
    return sorted((s for s in sources if names is None or s.name in names), key=lambda s: s.priority)


def fetch(sources: Sequence[Source], *args: Any, only: str | Sequence[str] | None = None, **kw: Any) -> DataFrame:
    """The first source, by priority, whose plan resolves; the errors of all if none does."""
    errors = []
    for s in ranked(sources, only):
        try:
            df = s.get(*args, **kw)
            df.schema  # noqa: B018  resolves the plan
            return df
        except Exception as e:  # each source may fail in its own way
            errors.append(e)
    raise ExceptionGroup("no source could serve the request", errors or [ValueError("there is no such source")])


def jdbc(spark: SparkSession, url: str, table: str, columns: Sequence[str] | None = None, *, where: Any = None, order_by: str | None = None, descending: bool = False, **options: Any) -> DataFrame:
    """A database table; filter and projection are pushed down, the order is Spark's."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    df = filters.where(df, where) if where is not None else df
    df = df.select(*columns) if columns else df
    return df.orderBy(df[order_by].desc() if descending else df[order_by]) if order_by else df


def reduced(source: DataFrame, channels: Sequence[str], start: float, end: float, path: str, **options: Any) -> None:
    """A reduced data set: some channels of some stretch, written."""
    from pyspark.sql import functions as F

    write(source.where(F.col("channel").isin(list(channels)) & (F.col("x") >= start) & (F.col("x") < end)), path, **options)
