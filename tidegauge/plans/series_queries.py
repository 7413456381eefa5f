"""Series, bits, two-dimensional tables, spectra and ranges over rows of 64 samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import kernels as K
from tidegauge.operators import qscan as Q
from tidegauge.operators import ranges as R
from tidegauge.operators import series as X
from tidegauge.operators import spectral as P
from tidegauge.plans.registry import SQL_EVENTS, SQL_SERIES, T0, events, query, r6, samples, series

V = lambda df, *c: df.withColumns({k: r6(F.col(k)) for k in c or ("value",)})


@query(f"SELECT channel, idx, value FROM {SQL_SERIES} WHERE idx >= 10 AND idx < 20")
def series_crop(spark, d):
    return X.crop(series(spark, d), 10.5, 20.2).select("channel", "idx", "value")


@query(f"SELECT channel, ((idx - 3) // 5)::BIGINT AS idx, x, value FROM {SQL_SERIES} WHERE idx >= 3 AND idx < 50 AND (idx - 3) % 5 = 0")
def series_slice_step(spark, d):
    return X.take(series(spark, d), 3, 50, 5)


@query(f"SELECT channel, value FROM {SQL_SERIES} WHERE x = 17")
def value_at(spark, d):
    return X.value_at(series(spark, d), 17.0)


@query(f"SELECT channel, idx - 1 AS idx, x, round(value - p, 6) + 0.0 AS value FROM (SELECT *, lag(value) OVER (PARTITION BY channel ORDER BY idx) AS p FROM {SQL_SERIES}) WHERE p IS NOT NULL")
def series_diff1(spark, d):
    return V(X.diff(series(spark, d)))


@query(f"SELECT channel, idx - 2 AS idx, x, round(value - 2 * p + q, 6) + 0.0 AS value FROM (SELECT *, lag(value) OVER w AS p, lag(value, 2) OVER w AS q FROM {SQL_SERIES} WINDOW w AS (PARTITION BY channel ORDER BY idx)) WHERE q IS NOT NULL")
def series_diff2(spark, d):
    return V(X.diff(series(spark, d), 2))


@query(f"SELECT channel, idx, x + 100.5 AS x, value FROM {SQL_SERIES}")
def series_shift(spark, d):
    return X.shift(series(spark, d), 100.5)


@query(f"SELECT channel, idx + 2 AS idx, x, value FROM {SQL_SERIES} UNION ALL SELECT channel, CASE WHEN k < 2 THEN k ELSE k + 64 END, CASE WHEN k < 2 THEN k - 2.0 ELSE k + 62.0 END, -1.0 FROM (SELECT DISTINCT channel FROM {SQL_SERIES}), range(5) r(k)")
def series_pad(spark, d):
    return X.pad(series(spark, d), 2, 3, value=-1.0)


def _halves(spark, d, gap):
    s = series(spark, d)
    a = X.crop(s, None, 32)
    b = X.shift(X.crop(s, 32, None), gap)
    return a, b


@query(f"SELECT channel, CASE WHEN idx < 32 THEN idx ELSE idx + 4 END AS idx, CASE WHEN idx < 32 THEN x ELSE x + 4 END AS x, value FROM {SQL_SERIES} UNION ALL SELECT channel, k + 32, k + 32.0, 9.0 FROM (SELECT DISTINCT channel FROM {SQL_SERIES}), range(4) r(k)")
def series_append_pad(spark, d):
    a, b = _halves(spark, d, 4.0)
    return X.append(a, b, dx=1.0, fill=9.0)


@query(f"SELECT channel, idx, x, value FROM {SQL_SERIES}")
def series_append_contiguous(spark, d):
    return X.append(*_halves(spark, d, 0.0), dx=1.0)


@query(f"SELECT channel, idx - 24 AS idx, x, value FROM {SQL_SERIES} WHERE idx >= 24")
def rolling_update(spark, d):
    a, b = _halves(spark, d, 0.0)
    return X.update(a, b, dx=1.0, size=40)


@query(f"""SELECT g.user_id, g.idx, ({T0} + g.idx * 21600.0)::DOUBLE AS x, coalesce(c, 0)::DOUBLE AS value FROM (SELECT DISTINCT user_id, i AS idx FROM events, range(120) r(i)) g
LEFT JOIN (SELECT user_id, floor((t - {T0}) / 21600)::BIGINT AS idx, count(*) AS c FROM {SQL_EVENTS} GROUP BY 1, 2) e ON e.user_id = g.user_id AND e.idx = g.idx""")
def series_gapfill(spark, d):
    return X.regrid(events(spark, d), time="t", value=F.count("*"), step=21600.0, start=T0, end=T0 + 120 * 21600, keys=["user_id"])


@query(f"SELECT a.channel, a.idx, a.x, round(a.value + coalesce(b.value, 0), 6) + 0.0 AS value FROM {SQL_SERIES} a LEFT JOIN {SQL_SERIES} b ON b.channel = a.channel AND b.idx = a.idx + 40")
def series_inject(spark, d):
    s = series(spark, d)
    return V(X.inject(s, X.take(s, 40)))


@query(f"""WITH p AS (SELECT user_id AS channel, floor(t / 3600) * 3600 AS s FROM {SQL_EVENTS} GROUP BY 1, 2),
w AS (SELECT channel, s, CASE WHEN abs(s - lag(s + 3600) OVER (PARTITION BY channel ORDER BY s)) < 1e-6 THEN 0 ELSE 1 END AS n FROM p)
SELECT channel, s::BIGINT AS start, (sum(n) OVER (PARTITION BY channel ORDER BY s ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS run FROM w""")
def contiguous_runs(spark, d):
    pieces = events(spark, d).select(F.col("user_id").alias("channel"), (F.floor(F.col("t") / 3600) * 3600).alias("start")).distinct().withColumn("end", F.col("start") + 3600)
    return X.contiguous_pieces(pieces).select("channel", "start", "run")


@query(f"SELECT channel, (idx // 16)::BIGINT AS step, round(sqrt(avg(value * value)), 6) AS value FROM {SQL_SERIES} GROUP BY 1, 2")
def rms(spark, d):
    return V(X.rms(series(spark, d), 16)).drop("x")


@query(f"SELECT channel, (idx // 20)::BIGINT AS step, round(avg(value * cos(0.3 * idx)), 6) + 0.0 AS re, round(-avg(value * sin(0.3 * idx)), 6) + 0.0 AS im FROM {SQL_SERIES} WHERE idx < 60 GROUP BY 1, 2")
def heterodyne(spark, d):
    return V(X.heterodyne(series(spark, d), F.col("idx") * 0.3, 20), "re", "im").drop("x")


@query(f"SELECT channel, step, round(sqrt(re * re + im * im), 6) AS mag, round(degrees(atan2(im, re)), 4) + 0.0 AS phase FROM (SELECT channel, (idx // 32)::BIGINT AS step, 2 * avg(value * cos({2 * math.pi * 0.125} * idx)) AS re, -2 * avg(value * sin({2 * math.pi * 0.125} * idx)) AS im FROM {SQL_SERIES} GROUP BY 1, 2)")
def demodulate(spark, d):
    out = X.demodulate(series(spark, d), 0.125, 32)
    return out.select("channel", "step", r6(F.col("mag")).alias("mag"), (F.round("phase", 4) + 0.0).alias("phase"))


@query(f"SELECT channel, idx, x, round(value - avg(value) OVER (PARTITION BY channel), 6) + 0.0 AS value FROM {SQL_SERIES}")
def detrend_const(spark, d):
    return V(X.detrend(series(spark, d)))


@query(f"SELECT channel, idx, x, round(value - a - b * idx, 6) + 0.0 AS value FROM {SQL_SERIES} JOIN (SELECT channel, regr_intercept(value, idx) AS a, regr_slope(value, idx) AS b FROM {SQL_SERIES} GROUP BY channel) USING (channel)")
def detrend_linear(spark, d):
    return V(X.detrend(series(spark, d), "linear"))


EDGE = "0.5 * (1 - cos(2 * pi() * %s / 15.0))"


@query(f"SELECT channel, idx, x, round(value * (CASE WHEN idx < 8 THEN {EDGE % 'idx'} ELSE 1 END) * (CASE WHEN 63 - idx < 5 THEN {EDGE % '(63 - idx)'} ELSE 1 END), 6) + 0.0 AS value FROM {SQL_SERIES}")
def taper(spark, d):
    return V(X.taper(series(spark, d), 8, 5))


@query(f"SELECT channel, idx, x, CASE WHEN (x >= 10 AND x < 14.5) OR (x >= 40 AND x < 41) THEN 0.0 ELSE value END AS value FROM {SQL_SERIES}")
def mask_const(spark, d):
    dead = spark.createDataFrame([(10.0, 14.5), (40.0, 41.0)], "start double, end double")
    return X.mask(series(spark, d), dead, dx=1.0, const=0.0, width=8.0)


M4 = "0.5 * (1 - cos(2 * pi() * %s / 7.0))"


@query(f"""SELECT channel, idx, x, round(CASE WHEN idx BETWEEN 10 AND 14 OR idx = 40 THEN 0.0
WHEN idx BETWEEN 6 AND 9 THEN value * {M4 % '(9 - idx)'} WHEN idx BETWEEN 15 AND 18 THEN value * {M4 % '(idx - 15)'}
WHEN idx BETWEEN 36 AND 39 THEN value * {M4 % '(39 - idx)'} WHEN idx BETWEEN 41 AND 44 THEN value * {M4 % '(idx - 41)'} ELSE value END, 6) + 0.0 AS value FROM {SQL_SERIES}""")
def mask_taper(spark, d):
    dead = spark.createDataFrame([(10.0, 14.5), (40.0, 41.0)], "start double, end double")
    return V(X.mask(series(spark, d), dead, dx=1.0, const=0.0, taper_samples=4, width=8.0))


SQL_RUNS = f"(SELECT channel, min(x) AS s, max(x) + 1 AS e, count(*) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY channel ORDER BY idx) AS k FROM {SQL_SERIES} WHERE value > 0) GROUP BY channel, k)"


@query(f'SELECT channel, s AS start, e AS "end" FROM {SQL_RUNS} WHERE n >= 3')
def runs_to_segments(spark, d):
    return X.runs(series(spark, d), least=3, flag=F.col("value") > 0)


@query(f"""SELECT channel, 'active' AS kind, s AS start, e AS "end" FROM {SQL_RUNS} UNION ALL SELECT vec_id, 'known', 0.0, 64.0 FROM embeddings""")
def state_to_flag(spark, d):
    return X.to_flag(series(spark, d).withColumn("value", F.col("value") > 0))


@query(f"SELECT channel, idx, (value > 0) <> p AS value FROM (SELECT *, lag(value > 0) OVER (PARTITION BY channel ORDER BY idx) AS p FROM {SQL_SERIES}) WHERE p IS NOT NULL")
def state_diff(spark, d):
    return X.state_diff(series(spark, d).withColumn("value", F.col("value") > 0)).select("channel", "idx", "value")


@query(f"SELECT channel, bool_and(value > -0.3) AS all_good FROM {SQL_SERIES} GROUP BY channel")
def state_all(spark, d):
    return series(spark, d).groupBy("channel").agg(F.bool_and(F.col("value") > -0.3).alias("all_good"))


SQL_BITS = f"(SELECT channel, idx, x, (abs(value) * 1000)::BIGINT AS value FROM (SELECT channel, idx, x, floor(value * 1000) / 1000 AS value FROM {SQL_SERIES}))"


def _bits(spark, d):
    return series(spark, d).withColumn("value", F.round(F.abs(F.floor(F.col("value") * 1000) / 1000) * 1000).cast("long"))


@query(f"SELECT channel, idx, b::INTEGER AS bit, ((value >> b) & 1) = 1 AS value FROM {SQL_BITS}, range(4) r(b)")
def bit_series(spark, d):
    return X.bit_series(_bits(spark, d), 4).select("channel", "idx", "bit", "value")


@query(f"SELECT channel, (idx // 4)::BIGINT AS step, bit_and(value & 63) AS value FROM {SQL_BITS} GROUP BY 1, 2")
def bits_and_resample(spark, d):
    return X.bits_resample(_bits(spark, d), 4, 6).select("channel", "step", "value")


@query(f"SELECT a.channel, k AS idx, k::DOUBLE * 0.7::DOUBLE AS x, round(a.value + coalesce((b.value - a.value) * (k * 0.7 - a.idx), 0), 6) + 0.0 AS value FROM range(91) r(k) JOIN {SQL_SERIES} a ON a.idx = floor(k * 0.7) LEFT JOIN {SQL_SERIES} b ON b.channel = a.channel AND b.idx = a.idx + 1")
def interp_linear(spark, d):
    return V(X.interpolate(series(spark, d), 0.7)).withColumn("x", F.col("idx") * 0.7)


@query("SELECT vec_id AS channel, true AS regular FROM embeddings")
def axis_regular(spark, d):
    return X.is_regular(series(spark, d))


@query("SELECT user_id AS channel, false AS regular FROM events GROUP BY user_id HAVING count(*) > 2")
def axis_irregular(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("channel"), F.col("event_id").alias("idx"), F.col("t").alias("x"))
    many = rows.groupBy("channel").count().where("count > 2").select("channel")
    return X.is_regular(rows.join(many, "channel", "left_semi"))


@query(f"SELECT channel, idx, x, round(sqrt(abs(value)) + ln(1 + abs(value)) * power(value, 2) + sin(value), 6) + 0.0 AS value, value > 0.1 AS high FROM {SQL_SERIES}")
def elementwise(spark, d):
    v = F.col("value")
    return series(spark, d).withColumn("high", v > 0.1).withColumn("value", r6(F.sqrt(F.abs(v)) + F.log(1 + F.abs(v)) * F.pow(v, F.lit(2)) + F.sin(v)))


# -- two-dimensional tables: time = label of the row's group, frequency = sample

SQL_2D = "(SELECT label AS channel, ti, fi, value FROM (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS ti, embedding FROM embeddings) , LATERAL (SELECT (i - 1)::BIGINT AS fi, abs(embedding[i]::DOUBLE) AS value FROM range(1, 65) r(i)))"


def _plane(spark, d):
    from pyspark.sql import Window

    rows = samples(spark, d).withColumn("ti", F.row_number().over(Window.partitionBy("label").orderBy("channel")).cast("long") - 1)
    return rows.select(F.col("label").alias("channel"), "ti", F.posexplode("samples").alias("fi", "value")).withColumns({"fi": F.col("fi").cast("long"), "value": F.abs("value")})


@query(f"SELECT channel, ti, fi, round(value / avg(value) OVER (PARTITION BY channel, fi), 6) + 0.0 AS value FROM {SQL_2D}")
def spec_ratio_mean(spark, d):
    return V(P.ratio(_plane(spark, d), "mean"))


@query(f"SELECT channel, ti, fi, round(value / m, 6) + 0.0 AS value FROM {SQL_2D} JOIN (SELECT channel, fi, median(value) AS m FROM {SQL_2D} GROUP BY 1, 2) USING (channel, fi)")
def spec_ratio_median(spark, d):
    return V(P.ratio(_plane(spark, d), "median").select("channel", "ti", "fi", "value"))


@query(f"SELECT channel, fi, round(quantile_cont(value, 0.9), 6) + 0.0 AS value FROM {SQL_2D} GROUP BY 1, 2")
def spec_percentile(spark, d):
    return V(P.percentile(_plane(spark, d), 90))


SQL_VAR = f"(SELECT g.channel, g.fi, g.bin, 0.0 + 0.5 * g.bin / 10 AS lo, 0.0 + 0.5 * (g.bin + 1) / 10 AS hi, coalesce(c, 0)::DOUBLE AS value FROM (SELECT DISTINCT channel, fi, b AS bin FROM {SQL_2D}, range(10) r(b)) g LEFT JOIN (SELECT channel, fi, least(floor(value / 0.5 * 10), 9)::BIGINT AS bin, count(*) AS c FROM {SQL_2D} WHERE value <= 0.5 GROUP BY 1, 2, 3) h ON h.channel = g.channel AND h.fi = g.fi AND h.bin = g.bin)"


@query(f"SELECT * FROM {SQL_VAR}")
def spec_variance(spark, d):
    return P.variance(_plane(spark, d), bins=10, low=0.0, high=0.5)


@query(f"SELECT channel, fi, bin, round(value / sum(value) OVER (PARTITION BY channel, fi), 6) AS value FROM {SQL_VAR}")
def spec_variance_norm(spark, d):
    return V(P.variance(_plane(spark, d), bins=10, low=0.0, high=0.5, norm=True)).select("channel", "fi", "bin", "value")


@query(f"SELECT channel, fi, arg_min(lo, (dist, bin)) AS value FROM (SELECT channel, fi, bin, lo, abs(sum(value) OVER (PARTITION BY channel, fi ORDER BY bin ROWS UNBOUNDED PRECEDING) - 20) AS dist FROM {SQL_VAR}) GROUP BY 1, 2")
def variance_percentile(spark, d):
    return P.variance_percentile(P.variance(_plane(spark, d), bins=10, low=0.0, high=0.5), 20)


@query(f"SELECT channel, fi AS ti, ti AS fi, value FROM {SQL_2D}")
def transpose(spark, d):
    return P.transpose(_plane(spark, d)).select("channel", "ti", "fi", "value")


@query(f"SELECT channel, ti, fi, value FROM {SQL_2D} WHERE fi >= 10 AND fi < 21")
def crop_frequencies(spark, d):
    return P.crop_frequencies(_plane(spark, d), 10.4, 21.7).select("channel", "ti", "fi", "value")


def _axis(how: str, fn: str):
    def made(spark, d):
        return V(P.reduce_axis(_plane(spark, d), how, "fi"))

    made.__name__ = f"axis_reduce_{how}"
    query(f"SELECT channel, fi, round({fn}(value), 6) + 0.0 AS value FROM {SQL_2D} GROUP BY 1, 2")(made)


for _how, _fn in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop"), ("var", "var_pop"), ("min", "min"), ("max", "max"), ("sum", "sum")):
    _axis(_how, _fn)


@query("SELECT label AS channel, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS ti, vec_id AS epoch FROM embeddings")
def stack_spectra(spark, d):
    rows = samples(spark, d).select(F.col("label").alias("channel"), F.col("channel").alias("epoch"))
    return P.from_spectra(rows, ["channel"]).select("channel", "ti", "epoch")


# -- spectra: the double sum over 64 samples is the oracle

PI2 = 2 * math.pi


def _sum(n: int, start: str, win: str = "1.0", mean: str = "0.0", src: str = "embeddings") -> str:
    """re and im of windowed segments: (channel, k segment, fi)."""
    return f"SELECT vec_id AS channel, k, fi, sum((embedding[{start} + j + 1] - {mean}) * {win} * cos({PI2} * j * fi / {n})) AS re, -sum((embedding[{start} + j + 1] - {mean}) * {win} * sin({PI2} * j * fi / {n})) AS im FROM {src}, range({n}) r(j), range({n // 2 + 1}) f(fi)"


DFT = f"(SELECT vec_id AS channel, fi, sum(embedding[j + 1] * cos({PI2} * j * fi / 64)) / 64 * (CASE WHEN fi = 0 THEN 1 ELSE 2 END) AS re, -sum(embedding[j + 1] * sin({PI2} * j * fi / 64)) / 64 * (CASE WHEN fi = 0 THEN 1 ELSE 2 END) AS im FROM embeddings, range(64) r(j), range(33) f(fi) GROUP BY 1, 2)"


@query(f"SELECT channel, fi, round(sqrt(re * re + im * im), 6) AS value FROM {DFT}")
def dft_amp(spark, d):
    out = P.fft(samples(spark, d), "samples")
    return out.select("channel", "fi", r6(F.hypot("re", "im")).alias("value"))


@query(f"SELECT channel, fi, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM {DFT}")
def dft_builtin(spark, d):
    """The same transform in built-in expressions alone."""
    rows = samples(spark, d).select("channel", F.posexplode(P.sql_dft(F.col("samples"), 64)).alias("fi", "z"))
    k = F.when(F.col("fi") == 0, 1.0).otherwise(2.0) / 64
    return V(rows.select("channel", F.col("fi").cast("long").alias("fi"), (F.col("z.re") * k).alias("re"), (F.col("z.im") * k).alias("im")), "re", "im")


@query(f"SELECT channel, idx, round(value, 6) + 0.0 AS value FROM {SQL_SERIES}")
def ifft_roundtrip(spark, d):
    return V(P.ifft(P.fft(samples(spark, d), "samples")))


def sql_density(nfft: int, step: int, segs: int, name: str = "e") -> str:
    """(channel, k, fi, re, im) of Hann-windowed, mean-free segments of the embeddings."""
    hann = f"(0.5 - 0.5 * cos({PI2} * j / {nfft}))"
    return f"""(WITH s AS (SELECT vec_id, label, k, embedding[k * {step} + 1 : k * {step} + {nfft}]::DOUBLE[] AS v FROM embeddings, range({segs}) q(k)),
m AS (SELECT vec_id, label, k, v, list_avg(v) AS mu FROM s)
SELECT vec_id AS channel, label, k, fi, sum((v[j + 1] - mu) * {hann} * cos({PI2} * j * fi / {nfft})) AS re, -sum((v[j + 1] - mu) * {hann} * sin({PI2} * j * fi / {nfft})) AS im
FROM m, range({nfft}) r(j), range({nfft // 2 + 1}) f(fi) GROUP BY ALL)"""


def sql_psd(nfft: int, step: int, segs: int) -> str:
    norm = sum((0.5 - 0.5 * math.cos(2 * math.pi * j / nfft)) ** 2 for j in range(nfft))
    return f"(SELECT channel, k, fi, (re * re + im * im) / {norm} * (CASE WHEN fi IN (0, {nfft // 2}) THEN 1 ELSE 2 END) AS p FROM {sql_density(nfft, step, segs)})"


@query(f"SELECT channel, fi, round(p, 6) + 0.0 AS value FROM {sql_psd(64, 64, 1)}")
def periodogram(spark, d):
    return V(P.psd(samples(spark, d), "samples", method="bartlett")).select("channel", "fi", "value")


def _psd(name, sql):
    def made(spark, d):
        return V(P.psd(samples(spark, d), "samples", fftlength=16, method=name)).select("channel", "fi", "value")

    made.__name__ = f"psd_{name}"
    query(sql)(made)


_psd("welch", f"SELECT channel, fi, round(avg(p), 6) + 0.0 AS value FROM {sql_psd(16, 8, 7)} GROUP BY 1, 2")
_psd("bartlett", f"SELECT channel, fi, round(avg(p), 6) + 0.0 AS value FROM {sql_psd(16, 16, 4)} GROUP BY 1, 2")
_psd("median", f"SELECT channel, fi, round(median(p) / {K.median_bias(7)}, 6) + 0.0 AS value FROM {sql_psd(16, 8, 7)} GROUP BY 1, 2")
_psd("median_mean", f"SELECT channel, fi, round(avg(p) / {K.median_bias(3)}, 6) + 0.0 AS value FROM (SELECT channel, fi, k % 2 AS odd, median(p) AS p FROM {sql_psd(16, 8, 6)} GROUP BY 1, 2, 3) GROUP BY 1, 2")


@query(f"SELECT channel, fi, round(sqrt(avg(p)), 6) + 0.0 AS value FROM {sql_psd(16, 8, 7)} GROUP BY 1, 2")
def asd(spark, d):
    return V(P.asd(samples(spark, d), "samples", fftlength=16, method="welch")).select("channel", "fi", "value")


def _pairs(spark, d):
    """Each row beside the next one."""
    s = samples(spark, d)
    return s.select("channel", F.col("samples").alias("x")).join(s.select((F.col("channel") - 1).alias("channel"), F.col("samples").alias("y")), "channel")


NORM16 = sum((0.5 - 0.5 * math.cos(2 * math.pi * j / 16)) ** 2 for j in range(16))
CROSS = f"""(WITH z AS MATERIALIZED (SELECT * FROM {sql_density(16, 8, 7)})
SELECT a.channel, a.fi, avg(a.re * b.re + a.im * b.im) / {NORM16} * (CASE WHEN a.fi IN (0, 8) THEN 1 ELSE 2 END) AS re, avg(a.re * b.im - a.im * b.re) / {NORM16} * (CASE WHEN a.fi IN (0, 8) THEN 1 ELSE 2 END) AS im,
avg(a.re * a.re + a.im * a.im) / {NORM16} * (CASE WHEN a.fi IN (0, 8) THEN 1 ELSE 2 END) AS pxx, avg(b.re * b.re + b.im * b.im) / {NORM16} * (CASE WHEN a.fi IN (0, 8) THEN 1 ELSE 2 END) AS pyy
FROM z a JOIN z b ON b.channel = a.channel + 1 AND b.k = a.k AND b.fi = a.fi GROUP BY a.channel, a.fi)"""


@query(f"SELECT channel, fi, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM {CROSS}")
def csd(spark, d):
    return V(P.csd(_pairs(spark, d), "x", "y", nfft=16, noverlap=8), "re", "im").drop("f")


@query(f"SELECT channel, fi, round((re * re + im * im) / (pxx * pyy), 5) + 0.0 AS value FROM {CROSS} WHERE fi BETWEEN 1 AND 7")
def coherence(spark, d):
    out = P.coherence(_pairs(spark, d), "x", "y", nfft=16, noverlap=8).where("fi between 1 and 7")
    return out.select("channel", "fi", (F.round("value", 5) + 0.0).alias("value"))


@query(f"SELECT channel, fi, round(re / pxx, 4) + 0.0 AS re, round(im / pxx, 4) + 0.0 AS im FROM {CROSS} WHERE fi BETWEEN 1 AND 7")
def transfer_function(spark, d):
    out = P.transfer_function(_pairs(spark, d), "x", "y", nfft=16, noverlap=8).where("fi between 1 and 7")
    return out.select("channel", "fi", *[(F.round(c, 4) + 0.0).alias(c) for c in ("re", "im")])


@query(f"SELECT channel, fi, round(stddev_pop(p) / avg(p), 5) + 0.0 AS value FROM {sql_psd(16, 8, 7)} WHERE fi BETWEEN 1 AND 7 GROUP BY 1, 2")
def rayleigh(spark, d):
    out = P.rayleigh(samples(spark, d), "samples", nfft=16, noverlap=8).where("fi between 1 and 7")
    return out.select("channel", "fi", (F.round("value", 5) + 0.0).alias("value"))


@query(f"SELECT channel, fi, round(avg(re) / 16 / 0.5 * (CASE WHEN fi = 0 THEN 1 ELSE 2 END), 6) + 0.0 AS re, round(avg(im) / 16 / 0.5 * (CASE WHEN fi = 0 THEN 1 ELSE 2 END), 6) + 0.0 AS im FROM {sql_density(16, 8, 7)} GROUP BY 1, 2")
def average_fft(spark, d):
    return V(P.average_fft(samples(spark, d), "samples", nfft=16, noverlap=8, window="hann"), "re", "im").drop("f")


@query(f"""SELECT channel, k::BIGINT AS ti, fi, round(p, 6) + 0.0 AS value FROM {sql_psd(16, 16, 4)}""")
def spectrogram(spark, d):
    """One density for each stride of 16 samples, from chunks of the long form."""
    out = P.spectrogram(series(spark, d), fs=1.0, stride=16, fftlength=16, overlap=0, method="welch")
    return V(out).select("channel", "ti", "fi", "value")


@query(f"""WITH p AS MATERIALIZED (SELECT * FROM {sql_psd(16, 8, 7)})
SELECT a.channel, a.k AS ti, a.fi, round(sum(b.p * (CASE WHEN a.k = b.k THEN 1 ELSE 0.5 END)) / sum(CASE WHEN a.k = b.k THEN 1 ELSE 0.5 END), 6) + 0.0 AS value FROM p a JOIN p b ON b.channel = a.channel AND b.fi = a.fi AND abs(b.k - a.k) <= 1 GROUP BY 1, 2, 3""")
def spectrogram2(spark, d):
    return V(P.segment_spectrogram(samples(spark, d), "samples", nfft=16, noverlap=8)).select("channel", "ti", "fi", "value")


@query(f"SELECT channel, k AS ti, fi, round(re / 8, 6) + 0.0 AS re, round(im / 8, 6) + 0.0 AS im FROM {sql_density(16, 14, 4)}")
def fftgram(spark, d):
    return V(P.fftgram(samples(spark, d), "samples", nfft=16), "re", "im").select("channel", "ti", "fi", "re", "im")


@query(f"SELECT vec_id AS channel, s::BIGINT AS ti, embedding[a + 1]::DOUBLE AS first_value, b - a AS n FROM embeddings, (VALUES {', '.join(f'({i}, {s}, {e})' for i, (s, e) in enumerate(X.chunks(64, 12, 5)))}) c(s, a, b)")
def chunk_table(spark, d):
    out = P.chunked(series(spark, d), 12, 5)
    return out.select("channel", "ti", F.col("samples")[0].alias("first_value"), F.size("samples").alias("n"))


PSD64 = sql_psd(64, 64, 1)
K1, B1 = R.inspiral_factor(), R.burst_factor()


def _noise(spark, d):
    """Densities of a detector-like size: the periodograms at 64 Hz bins, scaled."""
    out = P.psd(samples(spark, d), "samples", method="bartlett").where("fi between 1 and 31")
    return out.select("channel", "fi", (F.col("fi") * 32.0).alias("f"), ((F.col("value") + 0.01) * 1e-44).alias("value"))


NOISE = f"(SELECT channel, fi, fi * 32.0 AS f, (p + 0.01) * 1e-44 AS v FROM {PSD64} WHERE fi BETWEEN 1 AND 31)"


@query(f"SELECT channel, fi, round({K1} * pow(f, -7 / 3.0) / v, 6) AS value FROM {NOISE}")
def inspiral_density(spark, d):
    return V(R.inspiral_density(_noise(spark, d))).select("channel", "fi", "value")


@query(f"SELECT channel, round(sqrt(sum((f2 - f) * (a + b) / 2)), 6) AS value FROM (SELECT channel, f, a, lead(f) OVER w AS f2, lead(a) OVER w AS b FROM (SELECT channel, f, {K1} * pow(f, -7 / 3.0) / v AS a FROM {NOISE} WHERE f >= 40 AND f < {R.isco(1.4, 1.4)}) WINDOW w AS (PARTITION BY channel ORDER BY f)) GROUP BY channel")
def sensemon_range(spark, d):
    return V(R.inspiral_range(_noise(spark, d), fmin=40))


@query(f"SELECT channel, fi, round({B1} / (sqrt(v) * f), 6) AS value FROM {NOISE}")
def burst_spectrum(spark, d):
    return V(R.burst_spectrum(_noise(spark, d))).select("channel", "fi", "value")


@query(f"SELECT channel, round(cbrt(sum((f2 - f) * (a + b) / 2) / 400), 6) AS value FROM (SELECT channel, f, a, lead(f) OVER w AS f2, lead(a) OVER w AS b FROM (SELECT channel, f, pow({B1} / (sqrt(v) * f), 3) AS a FROM {NOISE} WHERE f >= 100 AND f < 500) WINDOW w AS (PARTITION BY channel ORDER BY f)) GROUP BY channel")
def burst_range(spark, d):
    return V(R.burst_range(_noise(spark, d)))


@query(f"SELECT channel % 10 AS channel, channel AS ti, round(sqrt(sum((f2 - f) * (a + b) / 2)), 6) AS value FROM (SELECT channel, f, a, lead(f) OVER w AS f2, lead(a) OVER w AS b FROM (SELECT channel, f, {K1} * pow(f, -7 / 3.0) / v AS a FROM {NOISE} WHERE f < {R.isco(1.4, 1.4)}) WINDOW w AS (PARTITION BY channel ORDER BY f)) GROUP BY channel")
def range_timeseries(spark, d):
    rows = _noise(spark, d).select((F.col("channel") % 10).alias("channel"), F.col("channel").alias("ti"), "fi", "f", "value")
    return V(R.range_timeseries(rows))


@query(f"SELECT channel % 10 AS channel, channel AS ti, fi, round({K1} * pow(f, -7 / 3.0) / v, 6) AS value FROM {NOISE}")
def range_spectrogram(spark, d):
    rows = _noise(spark, d).select((F.col("channel") % 10).alias("channel"), F.col("channel").alias("ti"), "fi", "f", "value")
    return V(R.range_spectrogram(rows)).select("channel", "ti", "fi", "value")


@query()
def cosmological_range(spark, d):
    return V(R.cosmological_range(_noise(spark, d), fmin=40), "horizon")


_T = f"{2 * math.sqrt(Q.MISMATCH / 3)!r}"


@query(f"""WITH n AS (SELECT greatest(1, ceil(ln(64.0 / 4.0) / sqrt(2) / {_T})) AS n), q AS (SELECT i, 4.0 * exp(ln(16.0) / n * (i + 0.5)) AS q, n FROM n, range(100) r(i) WHERE i < n)
SELECT i::INTEGER AS plane, round(q, 6) AS q FROM q""")
def q_planes(spark, d):
    return Q.plan(spark, 4.0, 1024.0).groupBy("plane").agg(F.round(F.first("q"), 6).alias("q"))


@query(f"""WITH n AS (SELECT greatest(1, ceil(ln(64.0 / 4.0) / sqrt(2) / {_T})) AS n), q AS (SELECT i AS plane, 4.0 * exp(ln(16.0) / n * (i + 0.5)) AS q FROM n, range(100) r(i) WHERE i < n),
l AS (SELECT *, 50 * q / ({PI2} * 4) AS low, 512 / (1 + sqrt(11) / q) AS high, sqrt(2 + q * q) AS a FROM q), m AS (SELECT *, ln(high / low) * a / 2 AS span FROM l), c AS (SELECT *, greatest(1, ceil(span / {_T})) AS n FROM m),
f AS (SELECT DISTINCT plane, q, floor(low * exp(2 / a * (i + 0.5) * span / n) / 0.25) * 0.25 AS f FROM c, range(2000) r(i) WHERE i < n)
SELECT plane::INTEGER AS plane, round(q, 6) AS q, (row_number() OVER (PARTITION BY plane ORDER BY f) - 1)::INTEGER AS row, f AS frequency, (2 ** ceil(log2(4 * {PI2} * f / q / {_T})))::BIGINT AS ntiles, round(2 * sqrt({PI2} / 2) * f / q, 6) AS bandwidth, (2 * floor(f / (q / sqrt(11)) * 4) + 1)::BIGINT AS windowsize FROM f""")
def q_tiling(spark, d):
    return Q.plan(spark, 4.0, 1024.0).withColumns({c: F.round(c, 6) for c in ("q", "bandwidth")})


# -- conditioning


def _filtered(name, fn, sql=None):
    def made(spark, d):
        out = P.per_channel(samples(spark, d), "samples", fn)
        return V(out.select("channel", F.posexplode("samples").alias("idx", "value")))

    made.__name__ = name
    query(sql)(made)


def _difference(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The difference equation of b and a along the first axis, as if the input had always been what it begins with."""
    b, a = b / a[0], a / a[0]
    gain = b.sum() / a.sum()
    past_x, past_y, out = [x[0]] * (len(b) - 1), [gain * x[0]] * (len(a) - 1), []
    for row in x:
        y = b[0] * row + sum((c * v for c, v in zip(b[1:], past_x)), 0 * row) - sum((c * v for c, v in zip(a[1:], past_y)), 0 * row)
        past_x, past_y = [row, *past_x][: len(b) - 1], [y, *past_y][: len(a) - 1]
        out.append(y)
    return np.array(out)


def _linear_sql(b: np.ndarray, a: np.ndarray, pad: int) -> str:
    """SQL of a zero-phase filter of 64 samples by its weights: both ends continued by ``pad`` samples turned about the end, the difference equation run forth and back."""
    x = np.eye(64, dtype=np.longdouble)
    x = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = _difference(b, a, _difference(b, a, x)[::-1])[::-1][pad : pad + 64]
    weights = ", ".join(f"({m}, {n}, {float(y[m, n])!r}::DOUBLE)" for m in range(64) for n in range(64))
    return f"SELECT channel, m::INTEGER AS idx, round(sum(value * w), 6) + 0.0 AS value FROM {SQL_SERIES} s JOIN (VALUES {weights}) d(m, n, w) ON d.n = s.idx GROUP BY 1, 2"


def _designed(name, z, p, k):
    """A filter by zeros, poles and gain; the SQL has the weights of the polynomials' difference equation."""
    b, a = np.real(k * np.poly(z)).astype(np.longdouble), np.real(np.poly(p)).astype(np.longdouble)
    order = max(len(z), len(p))
    pairs = -(-order // 2)
    pad = 3 * (2 * pairs + 1 - (order % 2 if len(z) == len(p) else 0))
    filt = K.sections(z, p, k)
    _filtered(name, lambda x: K.apply_filter(x, filt), _linear_sql(b, a, min(pad, 63)))


_designed("lowpass", *K.lowpass(8, 64))
_designed("highpass", *K.highpass(8, 64))
_designed("bandpass", *K.bandpass(6, 12, 64))
_designed("notch", *K.notch(10, 64))
_designed("zpk_filter", *K.digital([0.0], [1.0], 1.0, 64))
TAPS = K.design_fir("lowpass", 8, 16, 64)
_filtered("fir_filter", lambda x: K.apply_filter(x, TAPS), _linear_sql(np.asarray(TAPS, np.longdouble), np.ones(1, np.longdouble), min(3 * len(TAPS), 63)))
_filtered(
    "resample_decimate",
    lambda x: K.resample(x, 64, 16, n=8),
    f"""WITH h AS (SELECT k, (CASE k WHEN 4 THEN 0.25 ELSE sin({PI2} * (k - 4) / 8) / ({PI2} * (k - 4) / 2) END) * (0.54 - 0.46 * cos({PI2} * k / 8)) AS v FROM range(9) r(k)),
d AS (SELECT k, v / sum(v) OVER () AS w FROM h)
SELECT channel, ((idx - 4 + k) // 4)::INTEGER AS idx, round(sum(value * w), 6) + 0.0 AS value FROM {SQL_SERIES}, d WHERE (idx - 4 + k) % 4 = 0 AND idx - 4 + k BETWEEN 0 AND 63 GROUP BY 1, 2""",
)
_filtered(
    "resample_fourier",
    lambda x: K.resample(x, 64, 48),
    f"""WITH d AS (SELECT m, n, (1.0 + 2 * sum((0.54 + 0.46 * cos({PI2} * k / 64)) * cos({PI2} * k * (m / 48.0 - n / 64.0)))) / 64 + 2 * (0.54 + 0.46 * cos({PI2} * 24 / 64)) * cos({PI2} * m / 2) * cos({PI2} * 24 * n / 64) / 64 AS w FROM range(48) a(m), range(64) b(n), range(1, 24) c(k) GROUP BY m, n)
SELECT channel, m::INTEGER AS idx, round(sum(value * w), 6) + 0.0 AS value FROM {SQL_SERIES} s JOIN d ON d.n = s.idx GROUP BY 1, 2""",
)
_filtered("whiten", lambda x: K.whiten(x, 64, fftlength=0.25, overlap=0.125, fduration=0.25))
_filtered(
    "convolve",
    lambda x: K.convolve(x, np.array([0.25, 0.5, 0.25, 0.0])),
    f"SELECT channel, idx::INTEGER AS idx, round(0.25 * coalesce(lead(v) OVER w, 0) + 0.5 * v + 0.25 * coalesce(lag(v) OVER w, 0), 6) + 0.0 AS value FROM (SELECT channel, idx, value * (CASE idx WHEN 0 THEN 0 WHEN 1 THEN 0.5 WHEN 63 THEN 0.5 ELSE 1 END) AS v FROM {SQL_SERIES}) WINDOW w AS (PARTITION BY channel ORDER BY idx)",
)
_filtered(
    "correlate",
    lambda x: K.correlate(x, x[8:24]),
    f"""WITH s AS {SQL_SERIES}, a AS (SELECT channel, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS c FROM s GROUP BY 1), g AS (SELECT channel, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS c FROM s WHERE idx BETWEEN 8 AND 23 GROUP BY 1),
x AS (SELECT channel, idx, (value - b * idx - c) * (CASE WHEN idx < 8 THEN 0.5 - 0.5 * cos({PI2} * idx / 16) WHEN idx >= 56 THEN 0.5 - 0.5 * cos({PI2} * (idx - 48) / 16) ELSE 1 END) AS v FROM s JOIN a USING (channel)),
t AS (SELECT channel, idx - 8 AS j, value - b * idx - c AS v FROM s JOIN g USING (channel) WHERE idx BETWEEN 8 AND 23), n AS (SELECT channel, sqrt(sum(v * v)) AS norm FROM t GROUP BY 1)
SELECT channel, (x.idx + 8 - j)::INTEGER AS idx, round(sum(t.v * x.v) / any_value(norm), 6) + 0.0 AS value FROM x JOIN t USING (channel) JOIN n USING (channel) WHERE x.idx + 8 - j BETWEEN 0 AND 63 GROUP BY 1, 2""",
)
_filtered(
    "fir_from_transfer",
    lambda x: K.fir_from_transfer(x, 32, ncorner=2),
    f"""WITH t AS (SELECT channel, idx AS k, value * (CASE WHEN idx < 2 THEN 0 WHEN idx < 7 THEN 0.5 - 0.5 * cos({PI2} * (idx - 2) / 9) WHEN idx > 58 THEN 0.5 - 0.5 * cos({PI2} * (63 - idx) / 9) ELSE 1 END) * (CASE WHEN idx IN (0, 63) THEN 1 ELSE 2 END) AS v FROM {SQL_SERIES})
SELECT channel, j::INTEGER AS idx, round(sum(v * cos({PI2} * k * (j - 15) / 126)) / 126 * (0.5 - 0.5 * cos({PI2} * (j + 1) / 32)), 6) + 0.0 AS value FROM t, range(32) r(j) GROUP BY 1, 2, j""",
)
_filtered(
    "planck_window",
    lambda x: x * K.planck(64, 8, 8),
    f"SELECT channel, idx::INTEGER AS idx, round(value * (CASE WHEN k = 0 THEN 0 WHEN k < 8 THEN 1 / (exp(8.0 / k - 8.0 / (8 - k)) + 1) ELSE 1 END), 6) + 0.0 AS value FROM (SELECT *, least(idx, 63 - idx) AS k FROM {SQL_SERIES})",
)


@query()
def find_gates(spark, d):
    def made(x):
        g = K.gates(x * 200, 1.0, tzero=2.0, threshold=50.0, cluster_window=4, whitened=False)
        return {"start": np.array([s for s, _ in g], float), "end": np.array([e for _, e in g], float)}

    return P.per_row(samples(spark, d), ["channel"], ["samples"], made, "start double, end double")


@query()
def gate(spark, d):
    def made(x):
        y = x.copy()
        for s, e in K.gates(x * 200, 1.0, tzero=2.0, threshold=50.0, cluster_window=4, whitened=False):
            y[max(0, int(s)) : max(0, int(e))] = 0
        return {"idx": np.arange(len(y)), "value": y}

    return P.per_row(samples(spark, d), ["channel"], ["samples"], made, "idx long, value double")


@query()
def q_gram(spark, d):
    return Q.tiles_above(samples(spark, d), "samples", fs=64.0, snr=3.0, qrange=(4, 8), frange=(8, 24))


@query()
def q_transform(spark, d):
    return Q.transform(samples(spark, d), "samples", fs=64.0, nt=16, nf=8, qrange=(4, 8), frange=(8, 24))


@query()
def frequency_response(spark, d):
    spectrum = P.psd(samples(spark, d), "samples", fs=64.0, method="bartlett")
    return V(P.multiply_response(spectrum, K.lowpass(8, 64), fs=64.0))


def sql_segments(nfft: int, starts: str) -> str:
    """(channel, c, k, fi, re, im) of mean-free Hann segments of nfft samples at places of a table of (c, k, a)."""
    hann = f"(0.5 - 0.5 * cos({PI2} * j / {nfft}))"
    return f"""(WITH s AS (SELECT vec_id, c, k, embedding[a + 1 : a + {nfft}]::DOUBLE[] AS v FROM embeddings, {starts}), m AS (SELECT *, list_avg(v) AS mu FROM s)
SELECT vec_id AS channel, c, k, fi, sum((v[j + 1] - mu) * {hann} * cos({PI2} * j * fi / {nfft})) AS re, -sum((v[j + 1] - mu) * {hann} * sin({PI2} * j * fi / {nfft})) AS im
FROM m, range({nfft}) r(j), range({nfft // 2 + 1}) f(fi) GROUP BY ALL)"""


#: Segments of 8 samples, half overlapping, of the two chunks of 36 samples (the last ends with the data).
CHUNK8 = "(SELECT c, k, c * 28 + 4 * k AS a FROM range(2) x(c), range(8) y(k))"
NORM8 = sum((0.5 - 0.5 * math.cos(2 * math.pi * j / 8)) ** 2 for j in range(8))


@query(f"""WITH z AS MATERIALIZED (SELECT * FROM {sql_segments(16, "(SELECT c, k, 4 * c + 8 * k AS a FROM range(2) x(c), range(6) y(k))")})
SELECT a.channel, a.fi, round((pow(avg(a.re * b.re + a.im * b.im), 2) + pow(avg(a.re * b.im - a.im * b.re), 2)) / (avg(a.re * a.re + a.im * a.im) * avg(b.re * b.re + b.im * b.im)), 5) + 0.0 AS value
FROM z a JOIN z b ON b.channel = a.channel AND b.k = a.k AND b.fi = a.fi WHERE a.c = 0 AND b.c = 1 AND a.fi BETWEEN 1 AND 7 GROUP BY 1, 2""")
def auto_coherence(spark, d):
    out = P.auto_coherence(samples(spark, d), "samples", 4, nfft=16, noverlap=8).where("fi between 1 and 7")
    return out.select("channel", "fi", (F.round("value", 5) + 0.0).alias("value"))


@query()
def coherence_spectrogram(spark, d):
    s = series(spark, d)
    return V(P.coherence_spectrogram(s, X.shift(s, 0.0).withColumn("value", F.col("value") * F.cos("idx")), fs=1.0, stride=32, nfft=8))


@query(f"SELECT channel, c AS ti, fi, round(-avg(re * re + im * im) / {NORM8} * (CASE WHEN fi IN (0, 4) THEN 1 ELSE 2 END), 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM {sql_segments(8, CHUNK8)} GROUP BY 1, 2, 3")
def csd_spectrogram(spark, d):
    """Of each channel with its negative."""
    s = series(spark, d)
    return V(P.csd_spectrogram(s, s.withColumn("value", -F.col("value")), fs=1.0, stride=32, nfft=8, noverlap=4), "re", "im").drop("f")


@query(f"SELECT channel, c AS ti, fi, round(stddev_pop(re * re + im * im) / avg(re * re + im * im), 5) + 0.0 AS value FROM {sql_segments(8, CHUNK8)} WHERE fi BETWEEN 1 AND 3 GROUP BY 1, 2, 3")
def rayleigh_spectrogram(spark, d):
    out = P.rayleigh_spectrogram(series(spark, d), fs=1.0, stride=32, nfft=8, noverlap=4).where("fi between 1 and 3")
    return out.select("channel", "ti", "fi", (F.round("value", 5) + 0.0).alias("value"))


@query()
def spectral_variance(spark, d):
    gram = P.spectrogram(series(spark, d), fs=1.0, stride=16, fftlength=8)
    return P.variance(gram.withColumn("value", F.sqrt("value")), bins=20, low=1e-3, high=2.0, log=True)


@query(f"""WITH s AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM {SQL_SERIES} WINDOW w AS (PARTITION BY channel ORDER BY idx)),
b AS (SELECT channel, min(idx) FILTER (WHERE value > p AND value > q) AS t1, min(idx) FILTER (WHERE value < p AND value < q) AS l1, max(idx) FILTER (WHERE value > p AND value > q) AS t2, max(idx) FILTER (WHERE value < p AND value < q) AS l2 FROM s GROUP BY 1),
n AS (SELECT channel, least(greatest(t1, l1), 32) AS l, least(64 - least(t2, l2), 32) AS r FROM b)
SELECT channel, idx, x, round(value * (CASE WHEN idx < l THEN 0.5 - 0.5 * cos({PI2} * idx / (2 * greatest(l, r) - 1)) ELSE 1 END) * (CASE WHEN 63 - idx < r THEN 0.5 - 0.5 * cos({PI2} * (63 - idx) / (2 * greatest(l, r) - 1)) ELSE 1 END), 6) + 0.0 AS value FROM s JOIN n USING (channel)""")
def auto_taper(spark, d):
    return V(X.auto_taper(series(spark, d)))
