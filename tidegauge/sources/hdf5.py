"""Binary containers that need a library of their own: HDF5 (h5py), frames and ROOT trees.

Parquet is the engine's canonical storage. These formats are read where the
library is installed on the executors; without it, the read fails and says so.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.registry import register


def _need(module: str):
    import importlib

    try:
        return importlib.import_module(module)
    except ModuleNotFoundError as e:
        raise ModuleNotFoundError(f"this format needs the library {module!r} on every executor") from e


def read_hdf5(spark: SparkSession, paths: Sequence[str], *, datasets: Sequence[str] | None = None, start: float | None = None, end: float | None = None, spacing: str = "dx", origin: str = "x0") -> DataFrame:
    """(channel, idx, x, value) of one-dimensional data sets; their attributes name the axis. Reads only the samples of [start, end)."""
    _need("h5py")
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h5py = _need("h5py")
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with h5py.File(path, "r") as f:
                    names: list[str] = list(datasets or [])
                    if not names:
                        f.visititems(lambda n, o: names.append(n) if isinstance(o, h5py.Dataset) and o.ndim == 1 else None)
                    for n in names:
                        d = f[n]
                        x0, dx = float(d.attrs.get(origin, 0)), float(d.attrs.get(spacing, 1))
                        a = 0 if start is None else max(0, int((start - x0) // dx))
                        b = len(d) if end is None else min(len(d), int((end - x0) // dx))
                        for s in range(a, b, 1 << 18):
                            i = np.arange(s, min(b, s + (1 << 18)))
                            yield pa.RecordBatch.from_arrays([pa.array([n] * len(i)), pa.array(i), pa.array(x0 + i * dx), pa.array(d[i[0] : i[-1] + 1].astype(float))], names=["channel", "idx", "x", "value"])

    return files.mapInArrow(run, "channel string, idx long, x double, value double")


def read_open_hdf5(spark: SparkSession, paths: Sequence[str], **kw) -> DataFrame:
    """The public layout: values at strain/Strain, axis from Xstart and Xspacing."""
    return read_hdf5(spark, paths, datasets=["strain/Strain"], origin="Xstart", spacing="Xspacing", **kw)


def read_root(spark: SparkSession, paths: Sequence[str], *, treename: str = "tree") -> DataFrame:
    """A tree of a ROOT file as a table."""
    uproot = _need("uproot")
    first = uproot.open(f"{paths[0]}:{treename}")
    kinds = ", ".join(f"{n} double" for n in first.keys())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = _need("uproot")
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for part in lib.open(f"{path}:{treename}").iterate(step_size=100_000, library="np"):
                    yield pa.RecordBatch.from_pydict({k: v.astype(float) for k, v in part.items()})

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(run, kinds)


def read_frames(spark: SparkSession, paths: Sequence[str], *, channels: Sequence[str], start: float | None = None, end: float | None = None) -> DataFrame:
    """(channel, idx, x, value) of frame files, sieved by name before any is opened."""
    from tidegauge.sources.manifest import manifest, sieve

    _need("framel")
    files = manifest(spark.createDataFrame([(p,) for p in paths], "path string"))
    files = files if start is None else sieve(files, start, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = _need("framel")
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for c in channels:
                    data, x0, _, dx = lib.frgetvect1d(path, c)[:4]
                    i = np.arange(len(data))
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(i)), pa.array(i), pa.array(x0 + i * dx), pa.array(np.asarray(data, float))], names=["channel", "idx", "x", "value"])

    out = files.select("path").mapInArrow(run, "channel string, idx long, x double, value double")
    return out if start is None else out.where((F.col("x") >= start) & (F.col("x") < end))


def write_series(df: DataFrame, path: str, *, mode: str = "errorifexists", compression: str = "gzip") -> None:
    """The canonical container: Parquet by channel."""
    df.write.mode(mode).option("compression", compression).partitionBy("channel").parquet(path)


register("hdf5", read=read_hdf5, write=write_series, extensions=("hdf5", "h5", "hdf"))
register("hdf5.open", read=read_open_hdf5)
register("gwf", read=read_frames, extensions=("gwf",))
register("root", read=read_root, extensions=("root",))
register("root.omicron", read=lambda s, p, **o: read_root(s, p, **({"treename": "triggers"} | o)))
register("root.cwb", read=lambda s, p, **o: read_root(s, p, **({"treename": "waveburst"} | o)))
