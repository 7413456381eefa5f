import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import kernels as K
from tidegauge.operators import qscan as Q
from tidegauge.operators import ranges as R
from tidegauge.operators import series as X
from tidegauge.operators import spectral as P

RNG = np.random.default_rng(0)
NOISE = RNG.normal(size=20480)


def test_psd_of_a_tone_has_its_peak_and_size():
    fs, t = 2048, np.arange(20480) / 2048
    x = 2 * np.sqrt(2) * np.sin(2 * np.pi * 500 * t) + RNG.normal(size=t.size) * np.sqrt(1e-3 * fs / 2)
    for name in ("welch", "bartlett", "median", "median_mean", "scipy-welch"):
        p = K.psd(x, fs, 1024, 512 if K.method(name)[1] else 0, "hann", name)
        assert len(p) == 513 and np.argmax(p) * 2 == 500
    w = K.psd(NOISE, fs, 1024, 512, "hann", "welch")
    assert abs(w[5:-5].mean() * fs / 2 - 1) < 0.05
    assert abs(K.psd(NOISE, fs, 1024, 512, "hann", "median")[5:-5].mean() * fs / 2 - 1) < 0.05
    assert np.allclose(K.csd(x, x, fs, 1024, 512).real, K.psd(x, fs, 1024, 512, "hann", "welch"))
    assert np.allclose(K.coherence(x, x, fs, 1024, 512), 1)
    assert np.allclose(K.ifft(K.fft(NOISE)), NOISE)


def test_windows_and_parameters():
    assert np.allclose(K.window("hann", 8, False), np.hanning(8)) and np.allclose(K.window("hamming", 9, False), np.hamming(9)) and np.allclose(K.window("bartlett", 9, False), np.bartlett(9))
    assert K.recommended_overlap("hanning") == 0.5 and K.recommended_overlap("blackmanharris", 100) == 67
    assert K.fft_params(1000, 10.0, None, None, "hann", "welch") == (1000, 500) and K.fft_params(1000, 10.0, 8, None, "hann", "bartlett") == (80, 0)
    with pytest.raises(ValueError):
        K.window("nothing", 4)
    with pytest.raises(ValueError):
        K.window([1.0, 2.0], 3)
    assert K.register_method("My-Method", lambda p: p[0]) == "my_method" and K.psd(NOISE[:100], 1.0, 10, 0, "boxcar", "my-method").shape == (6,)


def gain(filt, f, fs):
    return np.abs(K.frequency_response(filt, np.array([float(f)]), fs))[0]


@pytest.mark.parametrize("kind", ["iir", "fir"])
def test_filter_designs_meet_their_losses(kind):
    fs = 1024
    low, high, band = K.lowpass(100, fs, type=kind), K.highpass(100, fs, type=kind), K.bandpass(100, 200, fs, type=kind)
    db = lambda f, x: 20 * np.log10(gain(f, x, fs))
    slack = 0.01 if kind == "iir" else 6.5
    assert db(low, 50) > -2 - slack and db(low, 150) < -30 + slack and db(low, 400) < -30
    assert db(high, 300) > -2 - slack and db(high, 60) < -30 + slack
    assert db(band, 150) > -2 - slack and db(band, 40) < -30 + slack and db(band, 400) < -30 + slack


def test_filters_on_tones():
    fs, t = 1024, np.arange(8192) / 1024
    a, b = np.sin(2 * np.pi * 20 * t), np.sin(2 * np.pi * 300 * t)
    mid = slice(2000, 6000)
    y = K.apply_filter(a + b, K.lowpass(60, fs))
    assert np.std(y[mid] - a[mid]) < 0.3 and abs(np.corrcoef(y[mid], a[mid])[0, 1]) > 0.999
    y = K.apply_filter(a + b, K.notch(300, fs))
    assert np.std(y[mid] - a[mid]) < 0.1
    # sections against a plain recursion
    sos = K.sections(*K.lowpass(60, fs))
    x = RNG.normal(size=500)
    want = x
    for b0, b1, b2, _, a1, a2 in sos:
        out, s1, s2 = [], 0.0, 0.0
        for u in want:
            v = b0 * u + s1
            s1, s2 = b1 * u - a1 * v + s2, b2 * u - a2 * v
            out.append(v)
        want = np.array(out)
    assert np.allclose(K.sosfilt(sos, x), want)
    f = np.linspace(0, 500, 50)
    assert np.allclose(K.frequency_response(sos, f, fs), K.frequency_response(K.lowpass(60, fs), f, fs))


def test_resampling_keeps_a_tone():
    t = np.arange(4096) / 1024
    x = np.sin(2 * np.pi * 8 * t)
    for kind in ("fir", "iir"):
        y = K.resample(x, 1024, 256, ftype=kind)
        assert len(y) == 1024 and np.abs(y[200:-200] - x[::4][200:-200]).max() < 0.05
    z = K.fourier_resample(x, 3000)
    assert np.abs(z - np.sin(2 * np.pi * 8 * np.arange(3000) / 750)).max() < 1e-9
    assert K.resample(x, 64, 64) is x


def test_whitening_gives_unit_variance():
    x = np.convolve(RNG.normal(size=65536), [1, 0.9, 0.5, 0.2], "same") * 7
    y = K.whiten(x, 1024.0, 2, 1, fduration=1, name="welch")[2048:-2048]
    assert abs(y.std() - 1) < 0.1 and abs(np.corrcoef(y[1:], y[:-1])[0, 1]) < 0.1


def test_convolution_paths_agree():
    x, h = RNG.normal(size=3000), RNG.normal(size=16)
    short = K.convolve(x[:100], h)
    assert len(short) == 100
    ref = np.array(x)
    w = K.window("hann", 16)
    ref[:8] *= w[:8]
    ref[-8:] *= w[-8:]
    assert np.allclose(K.convolve(x, h), np.convolve(ref, h)[7 : 7 + 3000])


def test_matched_filter_and_gates():
    t = np.arange(2048)
    pulse = np.sin(t[:64] / 3) * np.hanning(64)
    x = RNG.normal(size=2048) * 0.01
    x[1000:1064] += pulse
    snr = K.correlate(x, pulse)
    assert abs(int(np.argmax(np.abs(snr))) - 1032) <= 2
    loud = np.zeros(100)
    loud[[20, 23, 60]] = 60, 90, 70
    assert K.peaks(loud, 50, 5).tolist() == [23, 60]
    assert K.gates(loud, 1.0, tzero=2, cluster_window=5, whitened=False) == [(21.0, 25.0), (58.0, 62.0)]


def test_spline_is_exact_on_cubics():
    x = np.linspace(0, 3, 9)
    at = np.linspace(0, 3, 50)
    assert np.allclose(K.spline(x, x**3 - 2 * x, at), at**3 - 2 * at)


def test_q_scan_finds_a_pulse():
    fs, t = 1024, np.arange(4096) / 1024 - 2
    x = RNG.normal(size=4096) * 0.1 + 3 * np.exp(-((t / 0.05) ** 2)) * np.cos(2 * np.pi * 100 * t)
    q, rows, peak, far = Q.scan(x, fs, frange=(20, 300))
    f, e = max(rows, key=lambda r: r[1].max())
    assert 80 < f < 125 and abs(np.argmax(e) / len(e) * 4 - 2) < 0.1 and peak > 100 and far < 1e-10
    assert all(b > a for a, b in zip(Q.q_values(), Q.q_values()[1:])) and Q.tile(8, 64, 4)["ntiles"] & (Q.tile(8, 64, 4)["ntiles"] - 1) == 0
    with pytest.raises(ValueError):
        Q.scan(np.array([np.nan] * 64), 64)


def test_ranges(spark):
    f = np.arange(1, 1025.0)
    psd = spark.createDataFrame([(0, i, float(v), 1e-46) for i, v in enumerate(f)], "channel int, fi int, f double, value double")
    flat = 1e-46
    top = f[(f >= 40) & (f < R.isco(1.4, 1.4))]
    want = np.sqrt(np.trapezoid(R.inspiral_factor() * top ** (-7 / 3) / flat, top))
    assert abs(R.inspiral_range(psd, fmin=40).first().value / want - 1) < 1e-9
    assert abs(R.isco(1.4, 1.4) - 1570.4) < 1
    cosmo = R.cosmological_range(psd, fmin=40).first()
    assert cosmo.redshift > 0 and cosmo.horizon > want


def long(spark, x, name="a", dx=1.0, x0=0.0):
    return spark.createDataFrame([(name, i, x0 + i * dx, float(v)) for i, v in enumerate(x)], "channel string, idx long, x double, value double")


def vals(df):
    return [r.value for r in df.orderBy("idx").collect()]


def test_append_policies(spark):
    a, b = long(spark, [1, 2, 3]), long(spark, [4, 5], x0=5.0)
    assert vals(X.append(a, b, dx=1.0, fill=0.0)) == [1, 2, 3, 0, 0, 4, 5]
    assert [r.x for r in X.append(a, b, dx=1.0, gap="ignore").orderBy("idx").collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="gap"):
        X.append(a, b, dx=1.0).collect()
    with pytest.raises(Exception, match="overlap"):
        X.append(a, long(spark, [4], x0=1.0), dx=1.0, fill=0.0).collect()
    both = X.append(a, long(spark, [9], name="b"), dx=1.0)
    assert both.where("channel = 'b'").count() == 1 and both.count() == 4
    assert vals(X.prepend(b, a, dx=1.0, fill=0.0)) == [1, 2, 3, 0, 0, 4, 5]
    assert vals(X.update(a, long(spark, [4, 5], x0=3.0), dx=1.0, size=3)) == [3, 4, 5]


def test_series_small(spark):
    s = long(spark, np.arange(10.0) ** 2)
    assert vals(X.diff(s)) == np.diff(np.arange(10.0) ** 2).tolist() and vals(X.diff(s, 3)) == np.diff(np.arange(10.0) ** 2, 3).tolist()
    assert vals(X.crop(s, 2.5, 4.9)) == [4, 9] and vals(X.crop_irregular(s, 2.5, 4.9)) == [9, 16]
    assert vals(X.take(s, 1, 8, 3)) == [1, 16, 49]
    assert X.value_at(s, 3.0).first().value == 9 and X.value_at(s, 3.5).count() == 0
    assert [(r.start, r.end) for r in X.runs(s, flag=F.col("value") > 10, least=2).collect()] == [(4.0, 10.0)]
    assert vals(X.pad(s, 1, 1))[0] == 0 and X.pad(s, 1, 1).count() == 12
    assert X.chunks(100, 30, 10) == [(0, 40), (25, 65), (55, 95)]
    taper = vals(X.taper(long(spark, np.ones(20)), 4, 4))
    assert np.allclose(taper[:4], K.window("hann", 8, False)[:4]) and taper[10] == 1
    auto = vals(X.auto_taper(long(spark, np.cos(np.arange(40) / 3) + 2)))
    assert auto[0] == 0 and auto[20] == pytest.approx(np.cos(20 / 3) + 2)


def test_spectrogram_by_chunks_equals_the_kernel(spark):
    x = RNG.normal(size=256)
    out = P.spectrogram(long(spark, x), fs=1.0, stride=64, fftlength=32, overlap=16, method="welch").collect()
    table = {(r.ti, r.fi): r.value for r in out}
    for i, (s, e) in enumerate(X.chunks(256, 64, 16)):
        want = K.psd(x[s:e], 1.0, 32, 16, "hann", "welch")
        assert np.allclose([table[i, k] for k in range(17)], want)
    rows = X.to_arrays(long(spark, x))
    z = P.fft(rows, "samples").orderBy("fi").collect()
    assert np.allclose([r.re + 1j * r.im for r in z], K.fft(x))
    built = rows.select(P.sql_dft(F.slice("samples", 1, 16), 16).alias("z")).first().z
    assert np.allclose([r.re + 1j * r.im for r in built], np.fft.rfft(x[:16]))


def test_elliptic_prototype_and_notch():
    for order in (1, 2, 3, 5):
        z, p, k = K.elliptic(order, 1.0, 40.0)
        w = np.linspace(0, 1, 200)
        h = np.abs(k * np.prod(1j * w[:, None] - z, axis=1) / np.prod(1j * w[:, None] - p, axis=1))
        assert h.max() < 1 + 1e-9 and h.min() > 10 ** (-1 / 20) - 1e-9 and (p.real < 0).all()
    h = np.abs(k * np.prod(1j * np.linspace(2, 50, 500)[:, None] - z, axis=1) / np.prod(1j * np.linspace(2, 50, 500)[:, None] - p, axis=1))
    assert h.max() <= 10 ** (-40 / 20) * 1.001
    n = K.notch(60, 1024)
    db = lambda f: 20 * np.log10(gain(n, f, 1024))
    assert db(60) < -10 and db(60.1) < -9.9 and db(59.0) > -1.01 and db(61.0) > -1.01 and db(200) > -1.01
    assert K.elliptic_order(10, 1, 10) <= 2
