import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import sources, streaming
from tidegauge.operators.series import from_arrays
from tidegauge.sources import catalogue, manifest, registry, series, tables, xml
from tidegauge.sources.registry import Source


def test_formats(spark, tmp_path):
    assert sources.infer_format("a/b.csv.gz") == "csv" and sources.infer_format(["x.parquet", "y"]) == "parquet"
    with pytest.raises(ValueError):
        sources.infer_format("a.unknown")
    df = spark.createDataFrame([(1, 2.5, "a"), (2, 3.5, "b")], "id int, v double, s string")
    for f in ("parquet", "orc", "json", "csv"):
        sources.write(df, f"{tmp_path}/{f}", format=f)
        back = sources.read(spark, f"{tmp_path}/{f}", format=f, columns=["id", "v"], where="v > 3")
        assert [tuple(r) for r in back.collect()] == [(2, 3.5)]
    with pytest.raises(ValueError, match="no columns"):
        sources.read(spark, f"{tmp_path}/parquet", format="parquet", columns=["nope"])
    both = sources.read(spark, [f"{tmp_path}/parquet", f"{tmp_path}/parquet"], format="parquet", merge_function=sources.merge)
    assert both.count() == 4
    with pytest.raises(ValueError, match="differ"):
        sources.merge([df, df.drop("s")], "exact")
    assert sources.merge([df, df.drop("s")], "inner").columns == ["id", "v"]


def test_ranked_sources(spark):
    def fails(*_, **__):
        raise OSError("down")

    many = [Source("slow", lambda: spark.range(3), 20), Source("bad", fails, 1), Source("good", lambda: spark.range(2), 5)]
    assert [s.name for s in sources.ranked(many)] == ["bad", "good", "slow"] and sources.fetch(many).count() == 2
    with pytest.raises(ExceptionGroup):
        sources.fetch(many, only="bad")


def test_text_series_and_segments(spark, tmp_path):
    s = from_arrays(spark.createDataFrame([("c", [1.0, 2.0, 3.0])], "channel string, samples array<double>"), "samples", dx=0.5)
    sources.write(s, f"{tmp_path}/s.txt")
    assert [(r.idx, r.x, r.value) for r in sources.read(spark, f"{tmp_path}/s.txt", start=0.5).orderBy("x").collect()] == [(0, 0.5, 2.0), (1, 1.0, 3.0)]
    segs = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 7.0)], "start double, end double")
    sources.write(segs, f"{tmp_path}/x.seg")
    assert sorted(map(tuple, sources.read(spark, f"{tmp_path}/x.seg").collect())) == [(1.0, 2.0), (3.0, 4.0), (5.0, 7.0)]
    (tmp_path / "two.seg").write_text("# c\n1 2\n; c\n3 4\n")
    assert sources.read(spark, f"{tmp_path}/two.seg").count() == 2
    (tmp_path / "bad.seg").write_text("1 2 5\n")
    with pytest.raises(Exception, match="not a segment"):
        sources.read(spark, f"{tmp_path}/bad.seg").collect()
    assert series.read_segwizard(spark, [f"{tmp_path}/bad.seg"], strict=False).count() == 1


def test_json_flags(spark, tmp_path):
    flags = spark.createDataFrame([("X1:A:1", "known", 0.0, 9.0), ("X1:A:1", "active", 1.0, 2.0), ("X1:A:1", "active", 4.0, 5.0)], "flag string, kind string, start double, end double")
    sources.write(flags, f"{tmp_path}/f.flag.json", format="json.flag")
    assert sorted(map(tuple, sources.read(spark, f"{tmp_path}/f.flag.json", format="json.flag").collect())) == sorted(map(tuple, flags.collect()))


def test_cache_files(spark, tmp_path):
    files = manifest.manifest(spark.createDataFrame([("/d/A-B-0-1.tmp",), ("/d/A-B-1-1.tmp",), ("/d/A-B-4-1.tmp",), ("/d/odd.tmp",)], "path string"))
    assert sorted((r.start, r.end) for r in manifest.coverage(files).collect()) == [(0.0, 2.0), (4.0, 5.0)]
    assert [r.run for r in manifest.contiguous(files.where("start is not null")).orderBy("start").collect()] == [0, 0, 1]
    assert manifest.sieve(files, 1, 4).count() == 1
    with pytest.raises(Exception, match="not a file name"):
        manifest.sieve(files, 1, 4, strict=True).collect()
    good = files.where("start is not null")
    for layout in ("plain", "lal"):
        sources.write(good, f"{tmp_path}/{layout}.lcf", layout=layout)
        assert sorted(map(tuple, sources.read(spark, f"{tmp_path}/{layout}.lcf").collect())) == sorted(map(tuple, good.collect()))
    sources.write(good, f"{tmp_path}/x.ffl", layout="ffl")
    assert sources.read(spark, f"{tmp_path}/x.ffl", segment=(0, 1)).count() == 1


def test_commented_tables(spark, tmp_path):
    (tmp_path / "t.txt").write_text("% time [s]\n% frequency [Hz]\n% name\n1.5 20 abc\n2.5 30 def\n")
    df = sources.read(spark, f"{tmp_path}/t.txt", format="ascii.omega", where="frequency > 25")
    assert df.columns == ["time", "frequency", "name"] and [tuple(r) for r in df.collect()] == [(2.5, 30.0, "def")]
    (tmp_path / "c.txt").write_text("# time snr\n1 2\n")
    assert tables.read_commented(spark, [f"{tmp_path}/c.txt"]).first().snr == 2.0


def test_xml_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a b"), (2, None, "c,d")], "id int, snr double, name string")
    sources.write(df, f"{tmp_path}/t.xml", tablename="trig")
    assert sorted(map(tuple, sources.read(spark, f"{tmp_path}/t.xml", format="ligolw").collect())) == [(1, 2.5, "a b"), (2, None, "c,d")]
    xml.write_document({"a": df, "b": df.limit(0)}, f"{tmp_path}/two.xml")
    path = [f"{tmp_path}/two.xml"]
    assert xml.list_tables(spark, path) == ["a", "b"] and xml.read_table(spark, path, tablename="b").count() == 0
    assert xml.read_table(spark, path, tablename="a", columns=["snr"], rename={"snr": "rho"}).columns == ["rho"]
    with pytest.raises(ValueError):
        xml.read_table(spark, path)


def test_wav(spark, tmp_path):
    x = np.sin(np.arange(100) / 5)
    blocks = spark.createDataFrame([("c", x.tolist())], "channel string, samples array<double>")
    sources.write(blocks, f"file://{tmp_path}/w", format="wav", rate=50)
    got = sources.read(spark, f"{tmp_path}/w/c.wav").orderBy("idx").collect()
    assert np.allclose([r.value for r in got], x / np.abs(x).max(), atol=1e-6) and got[10].x == 0.2
    assert sources.read(spark, f"{tmp_path}/w/c.wav", start=1.0, end=1.5).count() == 25


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"events": {"E1": {"mass": 1.5, "mass_unit": "kg", "snr": 2.0}, "E2": {"mass": null, "mass_unit": "kg"}}}')
    df = catalogue.read_catalogue(spark, f"{tmp_path}/c.json")
    rows = {r.name: r for r in df.collect()}
    assert rows["E1"].mass == 1.5 and rows["E2"].mass is None and rows["E2"].snr is None
    assert df.schema["mass"].metadata == {"unit": "kg"}


def test_missing_libraries_say_so(spark):
    for f in ("hdf5", "root", "gwf"):
        with pytest.raises(ModuleNotFoundError, match="needs the library"):
            sources.read(spark, "x", format=f, **({"channels": ["c"]} if f == "gwf" else {}))


def test_reduced(spark, tmp_path):
    s = from_arrays(spark.createDataFrame([("a", [1.0] * 10), ("b", [2.0] * 10)], "channel string, samples array<double>"), "samples")
    registry.reduced(s, ["a"], 2, 5, f"{tmp_path}/r.parquet")
    assert spark.read.parquet(f"{tmp_path}/r.parquet").count() == 3


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "k" if i % 2 else "j", float(i)) for i in range(60)]
    spark.createDataFrame(rows, "idx long, t string, key string, value double").withColumn("ts", F.col("t").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    rates = run(streaming.event_rate_stream(read(), time="ts", stride="10 minutes", late="1 minute"), "complete", "rates")
    assert len(rates) == 6 and all(r.rate == 10 / 600 for r in rates)
    best = run(streaming.cluster_stream(read(), time="ts", gap="150 seconds", rank="value", late="1 minute", by=["key"]), "append", "sessions")
    assert all(r.n == 30 for r in best)
    held = run(streaming.rolling_buffer(read().select("key", "idx", "value"), size=4, keys=["key"]), "update", "held")
    assert sorted(r.idx for r in held if r.key == "j") == [52, 54, 56, 58]


def test_xml_flags_and_merges(spark, tmp_path):
    from tidegauge.sources import flags as FL

    f = spark.createDataFrame([("X1:A:1", "known", 0.0, 9.0), ("X1:A:1", "active", 1.0, 2.0), ("X1:B:2", "known", 0.0, 9.0)], "flag string, kind string, start double, end double")
    sources.write(f, f"{tmp_path}/f.xml", format="ligolw.flag")
    assert sorted(map(tuple, sources.read(spark, f"{tmp_path}/f.xml", format="ligolw.flag").collect())) == sorted(map(tuple, f.collect()))
    with pytest.raises(KeyError):
        FL.check_names(f, ["X1:A:1", "nope"])
    with pytest.warns(UserWarning, match="nope"):
        assert FL.merge_flags([f, f], names=["X1:A:1", "nope"], on_missing="warn", merged=True).count() == 2
    assert FL.merge_segments([f.select("start", "end")] * 2, merged=True).count() == 1
    assert FL.hosts("a.b:31,c", ["c", "d:1"]) == [("a.b", 31), ("c", None), ("d", 1)]


def test_pieces_and_padding(spark):
    from tidegauge.operators import series as X

    s = from_arrays(spark.createDataFrame([("a", [1.0, 2.0])], "channel string, samples array<double>"), "samples")
    far = s.withColumn("x", F.col("x") + 4)
    pieces = s.withColumn("piece", F.lit(1)).unionByName(far.withColumn("piece", F.lit(0)))
    assert [r.value for r in X.join_pieces(pieces, dx=1.0, fill=0.0).orderBy("idx").collect()] == [1, 2, 0, 0, 1, 2]
    assert [r.x for r in X.join_pieces(pieces, dx=1.0, gap="ignore").orderBy("idx").collect()] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="gap or an overlap"):
        X.join_pieces(pieces, dx=1.0).collect()
    with pytest.raises(Exception, match="does not cover"):
        X.pad_to(s, -1, 2, dx=1.0).collect()
    assert X.pad_to(s, 0, 2, dx=1.0).count() == 2
    with pytest.raises(ValueError, match="unit"):
        X.compatible({"dx": 1, "unit": "m"}, {"dx": 1, "unit": "s"})


def test_xml_arrays(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<LIGO_LW><LIGO_LW Name="REAL8FrequencySeries"><Time Name="epoch">10</Time><Param Name="f0:param">0</Param><Param Name="unit:param">m</Param>'
        '<Array Name="PSD:array"><Dim Start="5" Scale="0.5">3</Dim><Stream Delimiter=" ">1 2 3</Stream></Array></LIGO_LW>'
        '<LIGO_LW><Array Name="XY:array"><Dim>2</Dim><Dim>2</Dim><Stream Delimiter=",">0,7,1,8</Stream></Array></LIGO_LW></LIGO_LW>'
    )
    read = lambda **kw: [(r.name, r.x, r.value) for r in sources.read(spark, f"{tmp_path}/a.xml", format="ligolw.array", **kw).orderBy("name", "idx").collect()]
    assert read(name="PSD", epoch=10, unit="m") == [("PSD", 5.0, 1.0), ("PSD", 5.5, 2.0), ("PSD", 6.0, 3.0)]
    assert read(name="XY") == [("XY", 0.0, 7.0), ("XY", 1.0, 8.0)] and len(read()) == 5 and read(epoch=11) == []


def test_jdbc(spark):
    df = spark.createDataFrame([(1, 2.5), (2, 3.5), (3, 9.0)], "ID int, SNR double")
    url = "jdbc:derby:memory:tidegauge;create=true"
    df.write.jdbc(url, "TRIG", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    out = registry.jdbc(spark, url, "TRIG", ["ID"], where="SNR > 3", order_by="ID", descending=True, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert [r.ID for r in out.collect()] == [3, 2]
    assert "PushedFilters: [*IsNotNull(SNR), *GreaterThan(SNR,3.0)]" in out._jdf.queryExecution().toString()


def small_blocks(spark, size):
    """Files are read in blocks of so many bytes while this holds."""
    import contextlib

    @contextlib.contextmanager
    def held():
        old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        try:
            for k in old:
                spark.conf.set(k, str(size))
            yield
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)

    return held()


@pytest.mark.parametrize("size", [7, 40, 301, 100000])
def test_scan_config_files(spark, tmp_path, size):
    """A file reads as its text does, wherever it is cut into blocks."""
    from tidegauge.sources import channels

    block = "{\n  channelName: 'X1:%s' # {\n  sampleFrequency: 4096\n\n  searchFrequencyRange: [%d\n Inf]\n}\n"
    text = block % ("Z", 3) + "".join(f"[S{s},Title {s}]\n# [NO,No]\n" + "".join(block % (f"C{s}-{c}", c) for c in range(s)) for s in range(5)) + "{ channelName: 'X1:L'\n searchFrequencyRange: [0 8]\n }"
    (tmp_path / "scan.txt").write_text(text)
    key = lambda r: (r.channel, r.section, r.sample_rate, r.low, r.high, sorted(r.params.items()))
    with small_blocks(spark, size):
        got = channels.read_scan_config_file(spark, f"{tmp_path}/scan.txt").collect()
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, channels.read_scan_config(spark, text).collect()))) and len(got) == 12
    rows = spark.createDataFrame([("b", "y", 0.1234567, 8.0, None), ("a", "x", 64.0, 1e-7, float("inf")), ("a", "w", None, None, 1.0)], "section string, channel string, sample_rate double, low double, high double")
    channels.write_scan_config_file(rows, f"{tmp_path}/out")
    with small_blocks(spark, size):
        again = channels.read_scan_config_file(spark, f"{tmp_path}/out").drop("params").collect()
    assert sorted(map(tuple, again), key=str) == sorted([("b", "y", 0.1234567, 8.0, float("inf")), ("a", "x", 64.0, 1e-7, float("inf")), ("a", "w", None, None, None)], key=str)


@pytest.mark.parametrize("size", [5, 33, 100000])
def test_ini_files(spark, tmp_path, size):
    """A file reads as its text does, wherever it is cut into blocks."""
    from tidegauge.sources import channels

    text = "[DEFAULT]\nfhigh = 99\nowner: me\n\n# none\n[a]\n channels =\n   X1:A 256\n\n  X1:B\n ; none\n   X1:C 7\n note = one\n  two:\n\n    three = 3\n\n flow = 10\n[b]\nsample_rate = 16\nfhigh = Nyquist\nchannels = X1:A\n\tX1:D 8\n   X1:E\nlast = \n[empty]\nflow = 1\n[c]\n"
    text += "channels = X\n" + "".join(f"\tY{i} {i + 1}\n" for i in range(40)) + "[d]\nflow = 3\nchannels: Z"
    (tmp_path / "c.ini").write_text(text)
    key = lambda r: str((r.section, r.channel, r.sample_rate, r.low, r.high, sorted(r.params.items())))
    with small_blocks(spark, size):
        got = channels.read_ini_file(spark, f"{tmp_path}/c.ini").collect()
    want = channels.read_ini(spark, text).collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 3 + 3 + 41 + 1
    for odd in ("X = 1\n", "[a]\nword\n", "[a]\nx = 1\nx = 2\nchannels = A\n", "[a]\nchannels = A\n[a]\nx = 1\n"):
        (tmp_path / "odd.ini").write_text(odd)
        with small_blocks(spark, size), pytest.raises(Exception, match="no section|neither|twice"):
            channels.read_ini_file(spark, f"{tmp_path}/odd.ini").collect()
    rows = spark.createDataFrame([("b", "y", 0.1234567, {"flow": "8", "note": "p\nq"}), ("a", "x", 64.0, {}), ("b", "x", None, {"flow": "8", "note": "p\nq"})], "section string, channel string, sample_rate double, params map<string,string>")
    channels.write_ini_file(rows, f"{tmp_path}/out")
    with small_blocks(spark, size):
        again = channels.read_ini_file(spark, f"{tmp_path}/out").select("section", "channel", "sample_rate", "params").collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("size", [9, 50, 400, 100000])
def test_large_xml_files(spark, tmp_path, monkeypatch, size):
    """A file that is read in blocks has the tables that it has as a whole, wherever it is cut."""
    text = """<?xml version="1.0"?>
<!DOCTYPE LIGO_LW SYSTEM "x.dtd">
<LIGO_LW><Table Name="n:a:table"><Column Name="a:id" Type="int_8s"/>
<Column Name="a:v" Type="real_8"/> <!-- Column -->
<Column Name="a:s" Type="lstring"/><Stream Name="a:table" Delimiter=",">1,2.5,"a, \\"b\\"
c &amp; &lt;d&gt;&#13;",
  2,,"",3,
4.5 , plain ,4,5,&quot;x,y&quot;, <!-- 6,7, --> 5,6,"long
and, longer
and , longest \\\\",6,,,7,8
,"e"</Stream></Table>
<Table Name="b:table"><Column Name="x" Type="int_4s"/><Column Name="y" Type="int_4s"/>
<Stream Delimiter=";">
%s</Stream></Table><Table Name="none:table"><Column Name="x" Type="int_4s"/><Stream Delimiter=",">
</Stream></Table>
<Table Name="a:table"><Column Name="s" Type="lstring"/><Column Name="v" Type="real_8"/><Column Name="id" Type="int_8s"/><Stream>"last",1,8</Stream></Table>
</LIGO_LW>
""" % "".join(f"{i};{i + 1};\n" for i in range(60))
    (tmp_path / "x.xml").write_text(text.replace("\nand", "\r\nand"), newline="")
    path = [f"{tmp_path}/x.xml"]

    def read(name, **kw):
        return sorted(map(str, xml.read_table(spark, path, tablename=name, **kw).collect()))

    want = {n: read(n) for n in ("b", "none")}
    monkeypatch.setattr(xml, "WHOLE", 0)
    monkeypatch.setattr(xml, "_raw", lambda *_: pytest.fail("the file is parsed whole"))
    monkeypatch.setattr(xml, "LONGEST", 1000)
    with small_blocks(spark, size):
        assert xml.list_tables(spark, path) == ["a", "b", "none"]
        assert {n: read(n) for n in want} == want and len(want["b"]) == 60
        got = sorted(map(tuple, xml.read_table(spark, path, tablename="a", columns=["id", "v", "s"], rename={"s": "t"}).collect()), key=str)
        assert got == [(1, 2.5, 'a, "b"\nc & <d>\r'), (2, None, ""), (3, 4.5, "plain"), (4, 5.0, "x,y"), (5, 6.0, "long\nand, longer\nand , longest \\"), (6, None, None), (7, 8.0, "e"), (8, 1.0, "last")]


def test_odd_large_xml_files(spark, tmp_path, monkeypatch):
    """What blocks can't be read from is parsed whole."""
    monkeypatch.setattr(xml, "WHOLE", 0)
    table = '<LIGO_LW><Table Name="a:table"><Column Name="x"\n Type="int_4s"/><Stream Delimiter="{}">{}</Stream></Table></LIGO_LW>\n'
    for i, text in enumerate((table.format(",", "1,2"), table.replace("\n ", " ").format(" ", "1 2"), table.replace("\n ", " ").format(",", "<![CDATA[1,2]]>"), "<!-- \n -->" + table.replace("\n ", " ").format(",", "1,2"))):
        (tmp_path / f"{i}.xml").write_text(text)
        assert xml.list_tables(spark, [f"{tmp_path}/{i}.xml"]) == ["a"]
        assert sorted((r.x for r in xml.read_table(spark, [f"{tmp_path}/{i}.xml"]).collect()), key=str) == [1, 2]


def test_large_xml_flags(spark, tmp_path, monkeypatch):
    """Flags whose three tables are read in blocks."""
    rows = [(f"X1:F{i % 3}:1", k, float(i) - (k == "known") / 3, i + 0.1) for i in range(60) for k in ("known", "active")]
    f = spark.createDataFrame(rows, "flag string, kind string, start double, end double")
    sources.write(f, f"{tmp_path}/f", format="ligolw.flag")
    monkeypatch.setattr(xml, "WHOLE", 0)
    monkeypatch.setattr(xml, "_raw", lambda *_: pytest.fail("the file is parsed whole"))
    with small_blocks(spark, 500):
        assert sorted(map(tuple, sources.read(spark, f"{tmp_path}/f", format="ligolw.flag").collect())) == sorted(rows)


def test_numbered_lines(spark, tmp_path, monkeypatch):
    """Lines are written in the order of their numbers, in whatever order and packs they come."""
    from tidegauge.sources import lines

    rows = [(part, i + (i > 90) * 2**33, f"{part} {i} é\u2028" + "x" * (i % 7) * 30) for part in (2, 0, 1) for i in range(200)] + [(3, 0, None), (3, 1, ""), (4, 0, "y" * 5000), (-1, 7, "first\r")]
    df = spark.createDataFrame(rows, "part int, line long, value string")
    for chunk in (1, 300, 1 << 16):
        monkeypatch.setattr(lines, "CHUNK", chunk)
        for name, given in (("dealt", df.repartition(5, "line")), ("one", df.coalesce(1)), ("empty", df.limit(0))):
            lines.write_numbered(given, f"{tmp_path}/{name}{chunk}")
            got = [r.value for r in spark.read.option("lineSep", "\n").text(f"{tmp_path}/{name}{chunk}").coalesce(1).collect()]
            assert got == ([] if name == "empty" else [v or "" for _, _, v in sorted(rows, key=lambda r: r[:2])])


def test_xml_documents_are_written_in_packs(spark, tmp_path):
    """The one task that writes a document sorts packs of lines, not lines."""
    spark.sparkContext.setJobGroup("packs", "packs")
    try:
        xml.write_document({"a": spark.range(50000, numPartitions=3), "b": spark.range(50, numPartitions=2)}, f"{tmp_path}/d")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    read = [store.lastStageAttempt(s).shuffleReadRecords() for j in tracker.getJobIdsForGroup("packs") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < max(read) < 500
    lines = [r.value for r in spark.read.text(f"{tmp_path}/d").coalesce(1).collect()]
    assert [int(x[:-1]) for x in lines if x.endswith(",")] == [*range(50000), *range(50)] and lines[0].startswith("<?xml") and lines[-1] == "</LIGO_LW>"


@pytest.mark.parametrize("most", [100, 1])
def test_xml_flags_are_joined_without_sorts(spark, tmp_path, monkeypatch, most):
    """The names of few flags go to all executors, so that no task sorts all segments of a flag; more flags than that are joined all the same."""
    from tidegauge.sources import flags as FL

    rows = [(f"X1:F{i % 3}:1", k, float(i), i + 0.5) for i in range(30) for k in ("known", "active")]
    sources.write(spark.createDataFrame(rows, "flag string, kind string, start double, end double"), f"{tmp_path}/f", format="ligolw.flag")
    monkeypatch.setattr(FL, "MOST_NAMES", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sources.read(spark, f"{tmp_path}/f", format="ligolw.flag")
        assert sorted(map(tuple, out.collect())) == sorted(rows)
        assert ("SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()) == (most == 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_commented_header_in_order(spark, tmp_path, monkeypatch):
    """The comment lines are written before the rows, in order, whatever order their partitions come in; and read in order from small blocks."""
    from tidegauge.plans import io_queries

    made = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: made(*a, **k).orderBy(F.desc("value")))
    monkeypatch.setattr(io_queries, "place", lambda *_: f"{tmp_path}/t")
    df = io_queries.io_commented_table(spark, "/root/testdata/sf0.001")
    assert df.columns == ["id", "snr", "kind"] and df.where("kind in ('view', 'click', 'error', 'signup', 'purchase')").count() == df.count() > 0
    assert spark.read.text(f"{tmp_path}/t").head(3)[2].value == "# kind"
    with small_blocks(spark, 4):
        assert tables.read_commented(spark, [f"{tmp_path}/t"]).columns == df.columns
