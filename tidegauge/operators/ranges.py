"""How far a detector of a given noise density sees, on spectra (keys..., fi, f, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constants of nature in SI units.
C, G, SUN, MPC = 299792458.0, 6.6743e-11, 1.988409870698051e30, 3.085677581491367e22


def isco(m1: float, m2: float) -> float:
    """The frequency of the innermost stable orbit of two masses (solar)."""
    return C**3 / (G * 6**1.5 * math.pi * (m1 + m2) * SUN)


def inspiral_factor(snr: float = 8, m1: float = 1.4, m2: float = 1.4, horizon: bool = False) -> float:
    """The factor of f^(-7/3) / PSD, in Mpc^2."""
    chirp = (m1 * m2) ** 0.6 / (m1 + m2) ** 0.2 * SUN
    return (16 if horizon else 1.77**2) * 5 * C ** (1 / 3) * (chirp * G / C**2) ** (5 / 3) / (96 * math.pi ** (4 / 3) * snr**2) / MPC**2


def burst_factor(snr: float = 8, energy: float = 0.01) -> float:
    """The factor of PSD^(-1/2) / f, in Mpc."""
    return math.sqrt(G * energy * SUN * 0.4 / (math.pi**2 * C)) / snr / MPC


def inspiral_density(psd: DataFrame, snr: float = 8, m1: float = 1.4, m2: float = 1.4, *, horizon: bool = False) -> DataFrame:
    """The integrand of the inspiral range at each frequency but 0."""
    k = inspiral_factor(snr, m1, m2, horizon)
    return psd.where(F.col("f") > 0).withColumn("value", F.lit(k) * F.pow("f", F.lit(-7 / 3)) / F.col("value"))


def _trapezoid(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("f")
    area = (F.lead("f").over(w) - F.col("f")) * (F.lead("value").over(w) + F.col("value")) / 2
    return df.select(*keys, area.alias("__a")).groupBy(*keys).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("value"))


def _band(lo: float | None, hi: float | None) -> Column:
    cond = F.col("f") > 0 if lo is None else F.col("f") >= lo
    return cond if hi is None else cond & (F.col("f") < hi)


def inspiral_range(psd: DataFrame, snr: float = 8, m1: float = 1.4, m2: float = 1.4, fmin: float | None = None, fmax: float | None = None, *, horizon: bool = False, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """(keys..., value) in Mpc: the root of the integral over [fmin, fmax), no further than the innermost stable orbit."""
    top = min(fmax or math.inf, isco(m1, m2))
    return _trapezoid(inspiral_density(psd, snr, m1, m2, horizon=horizon).where(_band(fmin, top)), keys).withColumn("value", F.sqrt("value"))


def burst_spectrum(psd: DataFrame, snr: float = 8, energy: float = 0.01) -> DataFrame:
    """The burst range at each frequency but 0, in Mpc."""
    return psd.where(F.col("f") > 0).withColumn("value", F.lit(burst_factor(snr, energy)) / (F.sqrt("value") * F.col("f")))


def burst_range(psd: DataFrame, snr: float = 8, energy: float = 0.01, fmin: float = 100, fmax: float = 500, *, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """(keys..., value) in Mpc: the cube root of the mean cube over [fmin, fmax)."""
    cubes = burst_spectrum(psd, snr, energy).where(_band(fmin, fmax)).withColumn("value", F.pow("value", F.lit(3.0)))
    return _trapezoid(cubes, keys).withColumn("value", F.cbrt(F.col("value") / (fmax - fmin)))


def range_timeseries(spectrogram: DataFrame, how=inspiral_range, *, keys: Sequence[str] = ("channel",), **kw) -> DataFrame:
    """(keys..., ti, value): a range for each row of a spectrogram."""
    return how(spectrogram, keys=[*keys, "ti"], **kw)


def range_spectrogram(spectrogram: DataFrame, how=inspiral_density, **kw) -> DataFrame:
    """The integrand for each row of a spectrogram."""
    return how(spectrogram, **kw)


def cosmological_range(psd: DataFrame, snr: float = 8, m1: float = 1.4, m2: float = 1.4, fmin: float | None = None, fmax: float | None = None, *, hubble: float = 67.66, matter: float = 0.3097, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """(keys..., horizon, redshift): the horizon with redshifted masses in a flat universe, by iteration to a fixed point on the driver's side of the plan."""
    base = inspiral_range(psd, snr, m1, m2, fmin, fmax, horizon=True, keys=keys)

    @F.pandas_udf("double")
    def redshift(d):
        import numpy as np
        import pandas as pd

        z = np.linspace(0, 10, 20001)
        e = 1 / np.sqrt(matter * (1 + z) ** 3 + 1 - matter)
        luminosity = (1 + z) * np.concatenate([[0], np.cumsum((e[1:] + e[:-1]) / 2 * np.diff(z))]) * C / 1000 / hubble
        return pd.Series([float(z[np.argmin(np.abs(luminosity - v * (1 + z) ** (5 / 6)))]) for v in d])

    out = base.withColumn("redshift", redshift(F.col("value")))
    return out.select(*keys, (F.col("value") * F.pow(1 + F.col("redshift"), F.lit(5 / 6))).alias("horizon"), "redshift")
