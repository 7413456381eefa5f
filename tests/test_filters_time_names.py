import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import derived, filters, gpstime, names
from tidegauge.sources import channels


def test_filter_language():
    p = filters.parse_filter
    assert p("snr > 5") == [("snr", ">", 5.0)]
    assert p("5 <= snr") == [("snr", ">=", 5.0)]
    assert p("-10.5 < x <= 1e3") == [("x", ">", -10.5), ("x", "<=", 1000.0)]
    assert p("band == 'a and b' & y != 2 && z = 3") == [("band", "==", "a and b"), ("y", "!=", 2.0), ("z", "=", 3.0)]
    for bad in ("x", "x >", "1 < 2", "x > 1 > ", "x ! 3", "a < b < c"):
        with pytest.raises(ValueError):
            p(bad)
    assert filters.parse_filters("a > 1", ["b < 2", ("c", "<", 3)]) == [("a", ">", 1.0), ("b", "<", 2.0), ("c", "<", 3)]


def test_filters_chained_equal_combined(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    a = filters.where(filters.where(df, "id > 20"), "v <= 3").collect()
    assert a == filters.where(df, "id > 20 and v <= 3").collect() and len(a) > 0
    assert filters.where(df.limit(0), "id > 5").count() == 0
    pushed = filters.where(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "value > 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,5.0)]" in pushed


def test_sql_builder():
    assert filters.sql_query("t") == "SELECT * FROM t"
    assert filters.sql_query("t", ["a", "b"], where=["a > 1", "b == 'x'"], order_by="a", descending=True) == "SELECT a, b FROM t WHERE a > 1.0 AND b = 'x' ORDER BY a DESC"


@pytest.mark.parametrize(
    ("value", "want"),
    [("Jan 1 2017", "1167264018"), ((2017, 1, 1), "1167264018"), ("Sep 14 2015 09:50:45.391", "1126259462.391"), ("Oct 30 2016 12:34 CST", "1161887657"), (dt.date(2017, 1, 1), "1167264018"), (5.5, "5.5")],
)
def test_gps_golden_values(value, want):
    assert str(gpstime.gps(value)).rstrip("0").rstrip(".") == want


def test_gps_columns(spark):
    with pytest.raises(ValueError):
        gpstime.gps("random string")
    rows = spark.createDataFrame([("2017-01-01 00:00:00",), ("2015-09-14 09:50:45.391",), ("2016-12-31 23:59:59",)], "s string").withColumn("ts", F.col("s").cast("timestamp"))
    got = rows.select(gpstime.to_gps(F.col("ts")).alias("g"), gpstime.to_gps_exact(F.col("ts")).alias("x"), (gpstime.from_gps(gpstime.to_gps(F.col("ts"))) == F.col("ts")).alias("same")).collect()
    assert [r.g for r in got] == [1167264018.0, 1126259462.391, 1167264016.0] and all(r.same for r in got)
    assert str(got[1].x) == "1126259462.391000000"
    leap = spark.createDataFrame([(1167264017.5,)], "g double")
    assert leap.select(gpstime.from_gps(F.col("g"), on_leap="null").alias("t")).first().t is None
    with pytest.raises(Exception, match="leap second"):
        leap.select(gpstime.from_gps(F.col("g"))).collect()
    words = spark.createDataFrame([("yesterday",), ("2020-02-03 04:05:06",), ("nonsense",)], "s string").select(gpstime.parse_time(F.col("s")).alias("t")).collect()
    assert words[0].t is not None and words[1].t == dt.datetime(2020, 2, 3, 4, 5, 6) and words[2].t is None


def test_names(spark):
    c = spark.createDataFrame([("X1:SYS-SUB_SIGNAL_DQ.mean,m-trend",), ("X1:SYS",), ("nothing",)], "n string")
    got = c.select(names.channel_parts(F.col("n")).alias("p")).collect()
    assert tuple(got[0].p) == ("X1", "SYS", "SUB", "SIGNAL_DQ", "mean", "m-trend") and tuple(got[1].p)[:2] == ("X1", "SYS") and got[2].p.system is None
    f = spark.createDataFrame([("X1:TAG-A:3",), ("X1:TAG",), ("TAG:2",)], "n string")
    assert [tuple(r) for r in f.select(*[names.flag_part(F.col("n"), p) for p in ("ifo", "tag", "version")]).collect()] == [("X1", "TAG-A", 3), ("X1", "TAG", None), (None, "TAG", 2)]
    assert spark.createDataFrame([("a,b,m-trend,c",)], "t string").select(names.split_names(F.col("t")).alias("x")).first().x == ["a", "b,m-trend", "c"]
    p = spark.createDataFrame([("/d/A-B_C-10-4.gwf",), ("file.txt",)], "p string").select(names.file_segment(F.col("p")).alias("s")).collect()
    assert tuple(p[0].s) == (10.0, 14.0) and p[1].s.start is None


def test_derived(spark):
    df = spark.createDataFrame([(1.4, 1.4, 10.0, 2.0)], "mass1 double, mass2 double, snr double, chisq double")
    r = derived.with_derived(df, ["mtotal", "mchirp", "new_snr", "snr"]).first()
    assert r.mtotal == 2.8 and abs(r.mchirp - 1.2187708) < 1e-6 and abs(r.new_snr - 10 * (0.5 * (1 + 8)) ** (-1 / 6)) < 1e-12
    with pytest.raises(KeyError):
        derived.with_derived(df, ["nothing"])
    assert derived.num_taps(4096, 30, 2, 30) % 2 == 1 and derived.num_taps(100, -10, 2, 30) == int(2 / 3 * 2.2 * 10)


def test_channel_files(spark):
    text = "[grp]\nflow = 10\nfhigh = Nyquist\nchannels = X1:A 256\n\tX1:B\n"
    rows = channels.read_ini(spark, text).collect()
    assert [(r.section, r.channel, r.sample_rate, r.low, r.high) for r in rows] == [("grp", "X1:A", 256.0, 10.0, None), ("grp", "X1:B", None, 10.0, None)]
    assert channels.read_ini(spark, channels.write_ini(rows)).collect() == rows
    scan = "[CAL,Calibration]\n\n{\n  channelName: 'X1:A'\n  sampleFrequency: 4096\n  searchFrequencyRange: [0 Inf]\n}\n"
    rows = channels.read_scan_config(spark, scan).collect()
    assert (rows[0].section, rows[0].channel, rows[0].sample_rate, rows[0].low, rows[0].high) == ("CAL", "X1:A", 4096.0, 0.0, float("inf"))
    again = channels.read_scan_config(spark, channels.write_scan_config(rows)).collect()
    assert (again[0].channel, again[0].sample_rate) == ("X1:A", 4096.0)
    assert channels.parse_unit("counts") == "ct" and channels.parse_unit("odd") == "odd" and channels.density_unit("m") == "m^2/Hz"


def test_round_to_power_of_zero(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (3.0,), (4.0,), (None,)], "x double")
    got = df.select(*[derived.round_to_power(F.col("x"), 2, w) for w in (None, "lower", "upper")], derived.round_to_power(F.col("x"), 10)).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0), (0.25, 0.25, 0.5, 0.1), (4, 2, 4, 1), (4, 4, 4, 10), (None,) * 4]
