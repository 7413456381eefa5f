"""Constant-Q scan: tilings of the time-frequency plane, transforms, and tables of loud tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegauge.operators import kernels as K

MISMATCH, QRANGE, FRANGE = 0.2, (4.0, 64.0), (0.0, math.inf)


def step(mismatch: float) -> float:
    return 2 * math.sqrt(mismatch / 3)


def q_values(qrange=QRANGE, mismatch: float = MISMATCH) -> list[float]:
    """Values of Q, evenly in the logarithm so that neighbours mismatch by at most ``mismatch``."""
    span = math.log(qrange[1] / qrange[0]) / math.sqrt(2)
    n = max(1, math.ceil(span / step(mismatch)))
    return [qrange[0] * math.exp(math.sqrt(2) * span / n * (i + 0.5)) for i in range(n)]


def limits(q: float, duration: float, sampling: float, frange=FRANGE) -> tuple[float, float]:
    """The band that a plane covers: by default from 50 Q / (2 pi duration) to a little below the Nyquist frequency."""
    low = frange[0] or 50 * q / (2 * math.pi * duration)
    return low, sampling / 2 / (1 + math.sqrt(11) / q) if math.isinf(frange[1]) else frange[1]


def frequencies(q: float, duration: float, sampling: float, frange=FRANGE, mismatch: float = MISMATCH) -> list[float]:
    """Distinct frequencies of a plane, on multiples of 1 / duration."""
    low, high = limits(q, duration, sampling, frange)
    a = math.sqrt(2 + q * q)
    span = math.log(high / low) * a / 2
    n = max(1, math.ceil(span / step(mismatch)))
    grid = 1 / duration
    out: list[float] = []
    for i in range(n):
        f = low * math.exp(2 / a * (i + 0.5) * span / n) // grid * grid
        if not out or f != out[-1]:
            out.append(f)
    return out


def tile(q: float, f: float, duration: float, mismatch: float = MISMATCH) -> dict[str, float]:
    """Number of tiles in a row (a power of two), their bandwidth, and the size of the window over the spectrum."""
    cycles = duration * 2 * math.pi * f / q
    return {
        "ntiles": 2 ** math.ceil(math.log2(cycles / step(mismatch))),
        "bandwidth": 2 * math.sqrt(math.pi) * f / q,
        "windowsize": 2 * int(f / (q / math.sqrt(11)) * duration) + 1,
    }


def plan(spark: SparkSession, duration: float, sampling: float, qrange=QRANGE, frange=FRANGE, mismatch: float = MISMATCH) -> DataFrame:
    """(plane, q, row, frequency, ntiles, bandwidth, windowsize): every row of tiles; its size depends on the parameters alone."""
    rows = []
    for i, q in enumerate(q_values(qrange, mismatch)):
        for j, f in enumerate(frequencies(q, duration, sampling, frange, mismatch)):
            t = tile(q, f, duration, mismatch)
            rows.append((i, q, j, f, int(t["ntiles"]), t["bandwidth"], int(t["windowsize"])))
    return spark.createDataFrame(rows, "plane int, q double, row int, frequency double, ntiles long, bandwidth double, windowsize long")


def energies(spectrum: np.ndarray, q: float, f: float, duration: float, sampling: float, mismatch: float = MISMATCH, norm: str | None = "median") -> np.ndarray:
    """The energy of each tile of a row, over its median or mean."""
    t = tile(q, f, duration, mismatch)
    half, n, qp = int((t["windowsize"] - 1) // 2), int(t["ntiles"]), q / math.sqrt(11)
    i = np.arange(-half, half + 1)
    bell = (1 - (i / duration * qp / f) ** 2) ** 2 * n / (duration * sampling) * math.sqrt(315 * qp / (128 * f))
    at = np.round(i + 1 + f * duration).astype(int)
    part = np.where((at >= 0) & (at < len(spectrum)), spectrum[np.clip(at, 0, len(spectrum) - 1)], 0) * bell
    spare = n - len(part)
    left = int((spare - 1) / 2)
    padded = np.concatenate([np.zeros(max(left, 0)), part, np.zeros(max(spare - max(left, 0), 0))])
    e = np.abs(np.fft.ifft(np.fft.ifftshift(padded))) ** 2
    if norm:
        e = e / (np.median(e) if norm == "median" else e.mean())
    return e


def scan(x: np.ndarray, sampling: float, qrange=QRANGE, frange=FRANGE, mismatch: float = MISMATCH, norm: str | None = "median", search: tuple[float, float] | None = None) -> tuple[float, list[tuple[float, np.ndarray]], float, float]:
    """(q, [(frequency, energies)], peak energy, false-alarm rate) of the plane with the loudest tile; ``search`` limits where the peak may be (seconds)."""
    if not np.isfinite(x).all():
        raise ValueError("the series has values that are not numbers")
    duration, spectrum = len(x) / sampling, K.fft(x)
    best: tuple[float, list, float] | None = None
    tiles = planes = 0
    for q in q_values(qrange, mismatch):
        rows, peak = [], -1.0
        for f in frequencies(q, duration, sampling, frange, mismatch):
            e = energies(spectrum, q, f, duration, sampling, mismatch, norm)
            tiles += 1 + len(e) * step(mismatch)
            part = e if search is None else e[int(search[0] / duration * len(e)) : max(int(search[0] / duration * len(e)) + 1, int(search[1] / duration * len(e)))]
            peak = max(peak, float(part.max()))
            rows.append((f, e))
        planes += 1
        if best is None or peak > best[2]:
            best = (q, rows, peak)
    weight = 1 + math.log10(qrange[1] / qrange[0]) / math.sqrt(2)
    return best[0], best[1], best[2], 1.5 * tiles * weight / planes * math.exp(-best[2]) / duration


def _prepared(x: np.ndarray, sampling: float, whiten: bool) -> np.ndarray:
    return K.whiten(x, sampling) if whiten else x


def tiles_above(df: DataFrame, samples: str, *, fs: float, snr: float = 5.5, whiten: bool = False, keys: Sequence[str] = ("channel",), **kw) -> DataFrame:
    """(keys..., time, frequency, duration, bandwidth, energy, q) of the tiles of the loudest plane with energy >= snr^2 / 2."""
    fields = ["time", "frequency", "duration", "bandwidth", "energy", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [], []
            for i in range(batch.num_rows):
                x = _prepared(batch.column(samples)[i].values.to_numpy(zero_copy_only=False).astype(float), fs, whiten)
                q, rows, _, _ = scan(x, fs, **kw)
                for f, e in rows:
                    loud, width = np.flatnonzero(e >= snr * snr / 2), len(x) / fs / len(e)
                    b = np.full(len(loud), 2 * math.sqrt(math.pi) * f / q)
                    cols.append(np.stack([(loud + 0.5) * width, np.full(len(loud), f), np.full(len(loud), width), b, e[loud], np.full(len(loud), q)]))
                    at.append(np.full(len(loud), i))
            if at:
                take, table = pa.array(np.concatenate(at)), np.concatenate(cols, axis=1)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in keys], *[pa.array(c) for c in table]], names=[*keys, *fields])

    rows = df.select(*keys, samples)
    return rows.mapInArrow(run, ", ".join([*[f"{k} {t}" for k, t in rows.dtypes if k in keys], *[f"{c} double" for c in fields]]))


def transform(df: DataFrame, samples: str, *, fs: float, nt: int = 64, nf: int = 32, log_f: bool = False, whiten: bool = False, keys: Sequence[str] = ("channel",), **kw) -> DataFrame:
    """(keys..., ti, t, fi, f, value): the loudest plane on a regular grid, by cubic splines in time and in frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _prepared(batch.column(samples)[i].values.to_numpy(zero_copy_only=False).astype(float), fs, whiten)
                _, rows, _, _ = scan(x, fs, **kw)
                span, f = len(x) / fs, np.array([r[0] for r in rows])
                t = np.arange(nt) * span / nt
                grid = np.stack([K.spline(np.arange(len(e)) * span / len(e), e, np.minimum(t, span - span / len(e))) for _, e in rows])
                to = np.geomspace(f[0], f[-1], nf) if log_f else np.linspace(f[0], f[-1], nf)
                out = K.spline(f, grid.T, to)
                ti, fi = np.repeat(np.arange(nt), nf), np.tile(np.arange(nf), nt)
                take = pa.array(np.full(nt * nf, i))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in keys], pa.array(ti), pa.array(t[ti]), pa.array(fi), pa.array(to[fi]), pa.array(out.ravel())], names=[*keys, "ti", "t", "fi", "f", "value"])

    rows = df.select(*keys, samples)
    return rows.mapInArrow(run, ", ".join([*[f"{k} {t}" for k, t in rows.dtypes if k in keys], "ti long, t double, fi long, f double, value double"]))
