"""Spectra of sampled series.

A row holds the samples of one stretch of one channel (keys..., samples); the
numeric kernels run on Arrow batches of such rows. Long channels are cut into
(overlapping) chunks in closed form, so that a task holds chunks and never a
whole channel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import kernels as K

KEYS = ("channel",)


def per_row(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], fn: Callable[..., dict[str, np.ndarray]], fields: str) -> DataFrame:
    """Rows of arrays that ``fn`` makes of the input arrays of each row, with the keys repeated; ``fields`` is the schema of what it makes."""
    df = df.select(*keys, *inputs)
    names = [f.split()[0] for f in fields.split(", ")]
    schema = ", ".join([*[f"{k} {t}" for k, t in df.dtypes if k in keys], fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for i in range(batch.num_rows):
                arrays = [batch.column(c)[i].values for c in inputs]
                if any(a is None for a in arrays):
                    continue
                out = fn(*[a.to_numpy(zero_copy_only=False).astype(float) for a in arrays])
                made.append(out)
                at.append(np.full(len(out[names[0]]), i))
            if made:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in keys], *[pa.array(np.concatenate([m[n] for m in made])) for n in names]], names=[*keys, *names])

    return df.mapInArrow(run, schema)


def _frequencies(n: int, df: float) -> dict[str, np.ndarray]:
    return {"fi": np.arange(n, dtype=np.int64), "f": np.arange(n) * df}


SPECTRUM = "fi long, f double, value double"
COMPLEX = "fi long, f double, re double, im double"


def _complex(z: np.ndarray, df: float) -> dict[str, np.ndarray]:
    return _frequencies(len(z), df) | {"re": z.real, "im": z.imag}


def fft(df: DataFrame, samples: str, *, fs: float = 1.0, nfft: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., fi, f, re, im): the transform over n, bins from 1 on doubled."""
    return per_row(df, keys, [samples], lambda x: _complex(K.fft(x, nfft), fs / (nfft or len(x))), COMPLEX)


def ifft(df: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., idx, value) of complex spectra in long form."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fi", "re", "im"))).alias("z"))
    rows = rows.select(*keys, F.transform("z", lambda v: v["re"]).alias("re"), F.transform("z", lambda v: v["im"]).alias("im"))

    def back(re: np.ndarray, im: np.ndarray) -> dict[str, np.ndarray]:
        y = K.ifft(re + 1j * im)
        return {"idx": np.arange(len(y), dtype=np.int64), "value": y}

    return per_row(rows, keys, ["re", "im"], back, "idx long, value double")


def average_fft(df: DataFrame, samples: str, *, fs: float = 1.0, nfft: int, noverlap: int = 0, window=None, keys: Sequence[str] = KEYS) -> DataFrame:
    return per_row(df, keys, [samples], lambda x: _complex(K.average_fft(x, nfft, noverlap, window), fs / nfft), COMPLEX)


def psd(df: DataFrame, samples: str, *, fs: float = 1.0, fftlength: float | None = None, overlap: float | None = None, window="hann", method: str = "median", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., fi, f, value): the power density by a method of ``kernels.METHODS``."""
    name, registered = method, dict(K.METHODS)

    def made(x: np.ndarray) -> dict[str, np.ndarray]:
        K.METHODS.update(registered)
        nfft, noverlap = K.fft_params(len(x), fs, fftlength, overlap, window, name)
        p = K.psd(x, fs, nfft, noverlap, window, name)
        return _frequencies(len(p), fs / nfft) | {"value": p}

    return per_row(df, keys, [samples], made, SPECTRUM)


def asd(df: DataFrame, samples: str, **kw) -> DataFrame:
    return psd(df, samples, **kw).withColumn("value", F.sqrt("value"))


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of two channels side by side."""
    return a.withColumnRenamed("samples", "x").join(b.select(*keys, F.col("samples").alias("y")), list(keys))


def csd(df: DataFrame, x: str, y: str, *, fs: float = 1.0, nfft: int, noverlap: int = 0, window="hann", average: str = "mean", keys: Sequence[str] = KEYS) -> DataFrame:
    return per_row(df, keys, [x, y], lambda a, b: _complex(K.csd(a, b, fs, nfft, noverlap, window, average), fs / nfft), COMPLEX)


def coherence(df: DataFrame, x: str, y: str, *, fs: float = 1.0, fs_y: float | None = None, nfft: int, noverlap: int = 0, window="hann", keys: Sequence[str] = KEYS) -> DataFrame:
    """|Pxy|^2 / (Pxx Pyy); the faster of two channels of different rates is resampled first."""

    def made(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        low = min(fs, fs_y or fs)
        a, b = K.resample(a, fs, low), K.resample(b, fs_y or fs, low)
        n = min(len(a), len(b))
        c = K.coherence(a[:n], b[:n], low, nfft, noverlap, window)
        return _frequencies(len(c), low / nfft) | {"value": c}

    return per_row(df, keys, [x, y], made, SPECTRUM)


def auto_coherence(df: DataFrame, samples: str, lag: int, *, fs: float = 1.0, nfft: int, noverlap: int = 0, window="hann", keys: Sequence[str] = KEYS) -> DataFrame:
    """Coherence of a channel with itself ``lag`` samples later."""

    def made(x: np.ndarray) -> dict[str, np.ndarray]:
        n = abs(lag)
        c = K.coherence(x[: len(x) - n], x[n:], fs, nfft, noverlap, window)
        return _frequencies(len(c), fs / nfft) | {"value": c}

    return per_row(df, keys, [samples], made, SPECTRUM)


def transfer_function(df: DataFrame, x: str, y: str, *, fs: float = 1.0, nfft: int, noverlap: int = 0, window="hann", average: str = "mean", keys: Sequence[str] = KEYS) -> DataFrame:
    """Cross density over the density of x."""

    def made(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        z = K.csd(a, b, fs, nfft, noverlap, window, average) / K.average(K.density(a, fs, nfft, noverlap, window), average)
        return _complex(z, fs / nfft)

    return per_row(df, keys, [x, y], made, COMPLEX)


def rayleigh(df: DataFrame, samples: str, *, fs: float = 1.0, nfft: int, noverlap: int = 0, window="hann", keys: Sequence[str] = KEYS) -> DataFrame:
    def made(x: np.ndarray) -> dict[str, np.ndarray]:
        r = K.rayleigh(x, fs, nfft, noverlap, window)
        return _frequencies(len(r), fs / nfft) | {"value": r}

    return per_row(df, keys, [samples], made, SPECTRUM)


def chunked(series: DataFrame, stride: int, overlap: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., ti, x0, samples): overlapping chunks of long-form series, as ``series.chunks`` places them.

    Each sample computes the chunks that it belongs to; a task gathers a chunk.
    """
    length = stride + overlap
    size = series.groupBy(*keys).agg(F.count("*").alias("__n"))
    rows = series.join(size, list(keys))
    many = F.greatest(F.floor(F.col("__n") / stride), F.lit(1))
    start = lambda i: F.when(i == 0, 0).otherwise(i * stride - overlap // 2)
    placed = lambda i: F.when(start(i) + length > F.col("__n"), F.greatest(F.col("__n") - length, F.lit(0))).otherwise(start(i))
    first = F.greatest(F.floor((F.col("idx") - length) / stride), F.lit(0))
    rows = rows.withColumn("ti", F.explode(F.array_union(F.sequence(F.least(first, many - 1), F.least(F.floor((F.col("idx") + overlap) / stride), many - 1)), F.array(many - 1))))
    at = placed(F.col("ti"))
    rows = rows.where((F.col("idx") >= at) & (F.col("idx") < at + length))
    rows = rows.groupBy(*keys, "ti").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "value"))).alias("s"))
    return rows.select(*keys, F.col("ti").cast("long").alias("ti"), F.col("s")[0]["x"].alias("x0"), F.transform("s", lambda v: v["value"]).alias("samples"))


def spectrogram(series: DataFrame, *, fs: float, stride: float, fftlength: float | None = None, overlap: float | None = None, window="hann", method: str = "median", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., ti, fi, f, value): an averaged power density for each stride."""
    n = int(stride * fs)
    nfft, noverlap = K.fft_params(n, fs, fftlength or stride, overlap, window, method)
    if nfft > n or noverlap >= nfft:
        raise ValueError("a segment must fit into the stride, and its overlap into the segment")
    return psd(chunked(series, n, noverlap, keys), "samples", fs=fs, fftlength=nfft / fs, overlap=noverlap / fs, window=window, method=method, keys=[*keys, "ti"])


def paired_chunks(a: DataFrame, b: DataFrame, stride: int, overlap: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    return paired(chunked(a, stride, overlap, keys), chunked(b, stride, overlap, keys), [*keys, "ti"])


def csd_spectrogram(a: DataFrame, b: DataFrame, *, fs: float, stride: float, nfft: int, noverlap: int = 0, window="hann", keys: Sequence[str] = KEYS) -> DataFrame:
    return csd(paired_chunks(a, b, int(stride * fs), noverlap, keys), "x", "y", fs=fs, nfft=nfft, noverlap=noverlap, window=window, keys=[*keys, "ti"])


def coherence_spectrogram(a: DataFrame, b: DataFrame, *, fs: float, stride: float, nfft: int | None = None, noverlap: int = 0, window="hann", keys: Sequence[str] = KEYS) -> DataFrame:
    n = int(stride * fs)
    return coherence(paired_chunks(a, b, n, 0, keys), "x", "y", fs=fs, nfft=nfft or n // 2, noverlap=noverlap, window=window, keys=[*keys, "ti"])


def rayleigh_spectrogram(series: DataFrame, *, fs: float, stride: float, nfft: int, noverlap: int = 0, window="hann", keys: Sequence[str] = KEYS) -> DataFrame:
    return rayleigh(chunked(series, int(stride * fs), noverlap, keys), "samples", fs=fs, nfft=nfft, noverlap=noverlap, window=window, keys=[*keys, "ti"])


def fftgram(df: DataFrame, samples: str, *, fs: float = 1.0, nfft: int, noverlap: int | None = None, window="hann", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., ti, t, fi, f, re, im): the complex transform of each segment; times are the centres."""
    over = nfft // 8 if noverlap is None else noverlap

    def made(x: np.ndarray) -> dict[str, np.ndarray]:
        z = K.stft(x, nfft, over, window)
        m = z.shape[1]
        ti, fi = np.repeat(np.arange(len(z)), m), np.tile(np.arange(m), len(z))
        return {"ti": ti.astype(np.int64), "t": (ti * (nfft - over) + nfft / 2) / fs, "fi": fi.astype(np.int64), "f": fi * fs / nfft, "re": z.real.ravel(), "im": z.imag.ravel()}

    return per_row(df, keys, [samples], made, "ti long, t double, fi long, f double, re double, im double")


def segment_spectrogram(df: DataFrame, samples: str, *, fs: float = 1.0, nfft: int, noverlap: int = 0, window="hann", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., ti, fi, f, value): one periodogram a segment, averaged over the segments that overlap it with triangular weights."""

    def made(x: np.ndarray) -> dict[str, np.ndarray]:
        p = K.density(x, fs, nfft, noverlap, window)
        step = nfft - noverlap
        reach = (nfft - 1) // step
        out = np.zeros_like(p)
        total = np.zeros(len(p))
        for d in range(-reach, reach + 1):
            w = 1 - abs(d) * step / nfft
            rows = np.arange(max(0, -d), min(len(p), len(p) - d))
            out[rows] += w * p[rows + d]
            total[rows] += w
        out /= total[:, None]
        ti, fi = np.repeat(np.arange(len(out)), out.shape[1]), np.tile(np.arange(out.shape[1]), len(out))
        return {"ti": ti.astype(np.int64), "fi": fi.astype(np.int64), "f": fi * fs / nfft, "value": out.ravel()}

    return per_row(df, keys, [samples], made, "ti long, fi long, f double, value double")


def crop_frequencies(df: DataFrame, low: float | None = None, high: float | None = None, *, f0: float = 0.0, df_: float = 1.0) -> DataFrame:
    """Bins from int((low - f0) / df) up to, not including, int((high - f0) / df)."""
    if low is not None:
        df = df.where(F.col("fi") >= int((low - f0) / df_))
    if high is not None:
        df = df.where(F.col("fi") < int((high - f0) / df_))
    return df


def transpose(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"ti": "__t", "fi": "ti"}).withColumnRenamed("__t", "fi")


def reduce_axis(df: DataFrame, how: str, axis: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., index, value) over the other axis: mean, median, std, var (both of the population), min, max, sum."""
    agg = {"mean": F.avg, "median": F.median, "std": F.stddev_pop, "var": F.var_pop, "min": F.min, "max": F.max, "sum": F.sum}[how]
    return df.groupBy(*keys, axis).agg(agg("value").alias("value"))


def percentile(df: DataFrame, p: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., fi, value): the exact percentile over time by linear interpolation."""
    return df.groupBy(*keys, "fi").agg(F.percentile("value", F.lit(p / 100)).alias("value"))


def ratio(df: DataFrame, by: str | float | DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Divided by the mean or median over time, by a spectrum (keys..., fi, value) or by a number."""
    if isinstance(by, int | float):
        return df.withColumn("value", F.col("value") / float(by))
    if by == "mean" if isinstance(by, str) else False:
        w = Window.partitionBy(*[F.col(k) for k in keys], "fi")
        return df.withColumn("value", F.col("value") / F.avg("value").over(w))
    spectrum = reduce_axis(df, "median", "fi", keys) if isinstance(by, str) else by
    return df.join(spectrum.withColumnRenamed("value", "__by"), [*keys, "fi"]).withColumn("value", F.col("value") / F.col("__by")).drop("__by")


def variance(df: DataFrame, *, bins: int = 500, low: float, high: float, log: bool = False, norm: bool = False, density: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., fi, bin, lo, hi, value): a histogram of the values of each frequency over shared bins, dense.

    ``norm`` divides a row by its sum, ``density`` by its sum and the bin width.
    """
    if norm and density:
        raise ValueError("norm and density exclude each other")
    g = F.log10 if log else (lambda x: x)
    a, b = g(F.lit(float(low))), g(F.lit(float(high)))
    nth = F.least(F.floor((g(F.col("value")) - a) / (b - a) * bins), F.lit(bins - 1)).cast("long")
    counts = df.where((F.col("value") >= low) & (F.col("value") <= high)).groupBy(*keys, "fi", nth.alias("bin")).agg(F.count("*").alias("c"))
    edge = (lambda i: F.pow(F.lit(10.0), a + (b - a) * i / bins)) if log else (lambda i: a + (b - a) * i / bins)
    grid = df.select(*keys, "fi").distinct().select(*keys, "fi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    full = grid.join(counts, [*keys, "fi", "bin"], "left").select(*keys, "fi", "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("c", F.lit(0)).cast("double").alias("value"))
    if norm or density:
        total = F.sum("value").over(Window.partitionBy(*[F.col(k) for k in keys], "fi"))
        full = full.withColumn("value", F.when(total > 0, F.col("value") / total).otherwise(0.0))
    return full.withColumn("value", F.col("value") / (F.col("hi") - F.col("lo"))) if density else full


def variance_percentile(df: DataFrame, p: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., fi, value): the lower edge of the bin whose running sum is nearest to ``p``; the first of several."""
    run = F.sum("value").over(Window.partitionBy(*[F.col(k) for k in keys], "fi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__d", F.abs(run - p)).groupBy(*keys, "fi").agg(F.min_by("lo", F.struct("__d", "bin")).alias("value"))


def from_spectra(df: DataFrame, keys: Sequence[str] = (), order: str = "epoch") -> DataFrame:
    """Spectra (epoch, fi, value) stacked to a spectrogram: ti counts the epochs."""
    return df.withColumn("ti", F.dense_rank().over(Window.partitionBy(*[F.col(k) for k in keys]).orderBy(order)) - 1)


def multiply_response(df: DataFrame, filt, *, fs: float = 1.0, analog: bool = False, frequency: str = "f") -> DataFrame:
    """Spectra or spectrograms multiplied by the magnitude of a filter's response at their frequencies."""

    @F.pandas_udf("double")
    def gain(f):
        import pandas as pd

        return pd.Series(np.abs(K.frequency_response(filt, f.to_numpy(float), fs, analog)))

    return df.withColumn("value", F.col("value") * gain(F.col(frequency)))


def per_channel(df: DataFrame, samples: str, fn: Callable[[np.ndarray], np.ndarray], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., samples): any array function of whole rows, such as the filters of ``kernels``."""
    name = samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fn(v.values.to_numpy(zero_copy_only=False).astype(float)) for v in batch.column(name)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(out, pa.list_(pa.float64()))], names=[*keys, name])

    rows = df.select(*keys, samples)
    return rows.mapInArrow(run, ", ".join([*[f"{k} {t}" for k, t in rows.dtypes if k in keys], f"{name} array<double>"]))


def sql_dft(samples: Column, n: int, *, window: list[float] | None = None) -> Column:
    """The one-sided transform of a short array as array<struct<re, im>>, in built-in expressions only."""
    import math

    w = window or [1.0] * n
    both = F.zip_with(samples, F.array(*[F.lit(v) for v in w]), lambda a, b: a * b)
    total = lambda f, k: F.aggregate(F.transform(both, lambda v, i: v * f(i * k * (2 * math.pi / n))), F.lit(0.0), lambda s, v: s + v)
    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda k: F.struct(total(F.cos, k).alias("re"), (-total(F.sin, k)).alias("im")))
