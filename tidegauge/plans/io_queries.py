"""Round trips: whole tables are written in a format and read back, and the result is held against the table itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import sources
from tidegauge.plans.event_queries import CHANNEL
from tidegauge.plans.registry import SQL_SEGMENTS, SQL_SERIES, events, query, samples, segments, series, table
from tidegauge.sources import channels, tables, xml
from tidegauge.sources.lines import write_lines
from tidegauge.sources.registry import Source

KEY = "spark.checkpoint.dir"


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session's executors share; a local session may do without one."""
    base = spark.conf.get(KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{KEY} has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidegauge-io-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def back(df: DataFrame, name: str, format: str | None = None, write: dict | None = None, **read) -> DataFrame:
    """``df`` written and read; without a format, both go by the extension of ``name``."""
    path = place(df.sparkSession, name)
    sources.write(df, path, format=format, **(write or {}))
    return sources.read(df.sparkSession, path, format=format, **read)


def _plain(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")


PLAIN = "SELECT event_id, user_id, event_type, value, props FROM events"


@query(PLAIN)
def io_parquet(spark, d):
    return back(_plain(spark, d), "events.parquet")


@query(PLAIN)
def io_orc(spark, d):
    return back(_plain(spark, d), "events.orc")


@query("SELECT event_id, event_type, value FROM events WHERE value > 10 AND user_id < 50")
def io_json_columns_where(spark, d):
    return back(_plain(spark, d), "events.jsonl", columns=["event_id", "event_type", "value"], where="value > 10 and user_id < 50")


@query("SELECT event_id, user_id, event_type, value FROM events")
def io_csv_gz(spark, d):
    out = back(_plain(spark, d).drop("props"), "events.csv", write={"compression": "gzip"})
    return out.select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), "event_type", "value")


@query("SELECT event_id::DOUBLE AS x, value FROM events")
def io_text_series(spark, d):
    return back(events(spark, d).select(F.col("event_id").alias("x"), "value"), "events.txt").select("x", "value")


@query("SELECT event_id::DOUBLE AS x, value FROM events WHERE event_id >= 100 AND event_id < 5000")
def io_text_series_cropped(spark, d):
    return back(events(spark, d).select(F.col("event_id").alias("x"), "value"), "events.dat", start=100, end=5000).select("x", "value")


@query("SELECT event_id::DOUBLE AS x, value FROM events")
def io_csv_series(spark, d):
    rows = events(spark, d).select(F.col("event_id").alias("x"), "value")
    return back(rows, "series", "txt", write={"sep": ","}, sep=",").select("x", "value")


@query(f"SELECT s AS start, e AS \"end\" FROM {SQL_SEGMENTS}")
def io_segwizard(spark, d):
    return back(segments(spark, d).select("start", "end"), "all.seg")


KINDS = f"(SELECT flag, k AS kind, CASE k WHEN 'known' THEN s - 10 ELSE s END AS start, CASE k WHEN 'known' THEN e + 10 ELSE e END AS \"end\" FROM {SQL_SEGMENTS}, (VALUES ('known'), ('active')) t(k))"


def _flags(spark, d) -> DataFrame:
    """Known and active segments of flags X1:TYPE:1."""
    rows = segments(spark, d).withColumn("flag", F.concat(F.lit("X1:"), F.upper("flag"), F.lit(":1")))
    known = rows.select("flag", F.lit("known").alias("kind"), (F.col("start") - 10).alias("start"), (F.col("end") + 10).alias("end"))
    return known.union(rows.select("flag", F.lit("active"), "start", "end"))


FLAGS = f"SELECT 'X1:' || upper(flag) || ':1' AS flag, kind, start, \"end\" FROM {KINDS}"


@query(FLAGS)
def io_json_flags(spark, d):
    return back(_flags(spark, d), "flags", "json.flag")


@query(FLAGS)
def io_xml_flags(spark, d):
    return back(_flags(spark, d), "flags", "ligolw.flag")


MARKED = "SELECT event_id, value, CASE WHEN event_id % 10 = 0 THEN NULL ELSE props || ' \"a\", <b> & \\ ' || chr(9) || ' c' END AS note, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id::DOUBLE END AS user FROM events"


def _marked(spark, d) -> DataFrame:
    """Events with quotes, markup and nulls."""
    note = F.concat("props", F.lit(' "a", <b> & \\ \t c'))
    return table(spark, d, "events").select("event_id", "value", F.when(F.col("event_id") % 10 != 0, note).alias("note"), F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("double")).alias("user"))


@query(MARKED)
def io_xml_table(spark, d):
    return back(_marked(spark, d), "events.xml", write={"tablename": "event"})


@query("SELECT user_id::INTEGER AS id, value AS loudness FROM events")
def io_xml_table_columns(spark, d):
    """One table of a document of two, some columns, renamed."""
    path = place(spark, "two.xml")
    rows = table(spark, d, "events")
    xml.write_document({"other": segments(spark, d), "event": rows.select("event_id", F.col("user_id").cast("int").alias("user"), "value")}, path)
    return xml.read_table(spark, [path], tablename="event", columns=["user", "value"], rename={"user": "id", "value": "loudness"})


@query("SELECT unnest(['event', 'other']) AS name")
def io_xml_tables(spark, d):
    path = place(spark, "two.xml")
    xml.write_document({"other": segments(spark, d), "event": _marked(spark, d)}, path)
    return spark.createDataFrame([(n,) for n in xml.list_tables(spark, [path])], "name string")


@query(f"SELECT channel, idx, x / 64 AS x, value FROM {SQL_SERIES}")
def io_wav(spark, d):
    path = place(spark, "sound")
    sources.write(samples(spark, d), path, format="wav", rate=64, scale=1.0)
    out = sources.read(spark, f"{path}/*.wav", format="wav")
    return out.select(F.regexp_extract("channel", r"([0-9]+)\.wav$", 1).cast("long").alias("channel"), "idx", "x", "value")


@query("SELECT event_id::DOUBLE AS id, value AS snr, event_type AS kind FROM events")
def io_commented_table(spark, d):
    """A table whose comment lines name the columns, one a line."""
    path = place(spark, "triggers")
    rows = events(spark, d).select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("line"), F.concat_ws(" ", F.col("event_id").cast("string"), F.col("value").cast("string"), "event_type").alias("value"))
    head = spark.createDataFrame([(0, 0, "# id"), (0, 1, "# snr"), (0, 2, "# kind")], "part int, line long, value string")
    write_lines(head.union(rows), ["part", "line"], path)
    return tables.read_commented(spark, [path])


def _listed(spark, d) -> DataFrame:
    rows = events(spark, d).groupBy(F.expr("upper(event_type)").alias("section"), F.expr(CHANNEL).alias("name")).agg(F.count("*").alias("n"))
    return rows.select("section", F.split("name", "[.,]")[0].alias("channel")).distinct()


LISTED = f"(SELECT DISTINCT upper(event_type) AS section, split_part(split_part(name, '.', 1), ',', 1) AS channel FROM (SELECT *, {CHANNEL} AS name FROM events))"


@query(f"SELECT section, channel, 64.0::DOUBLE AS sample_rate, 8.0::DOUBLE AS low, 32.0::DOUBLE AS high FROM {LISTED}")
def io_channel_list(spark, d):
    rows = _listed(spark, d).withColumns({"sample_rate": F.lit(64.0), "params": F.create_map(*[F.lit(x) for x in ("flow", "8", "fhigh", "32")])})
    path = place(spark, "channels")
    channels.write_ini_file(rows, path)
    return channels.read_ini_file(spark, path).drop("params")


@query(f"SELECT section, channel, 64.0::DOUBLE AS sample_rate, 8.0::DOUBLE AS low, 'inf'::DOUBLE AS high FROM {LISTED}")
def io_scan_config(spark, d):
    rows = _listed(spark, d).withColumns({"sample_rate": F.lit(64.0), "low": F.lit(8.0), "high": F.lit(float("inf"))})
    path = place(spark, "scan")
    channels.write_scan_config_file(rows, path)
    return channels.read_scan_config_file(spark, path).drop("params")


@query(f"SELECT DISTINCT channel, regexp_extract(channel, '^[^:]*:([^-]*)', 1) AS system FROM {LISTED}")
def io_channel_rows(spark, d):
    from tidegauge.functions.names import channel_part

    return back(_listed(spark, d).select("channel").distinct(), "channels.jsonl").select("channel", channel_part(F.col("channel"), "system").alias("system"))


@query(PLAIN)
def fetch_fallback(spark, d):
    """The source that is tried first fails, the next one serves the request, the last one is not asked."""

    def down() -> DataFrame:
        raise OSError("down")

    return sources.fetch([Source("last", lambda: _plain(spark, d).limit(0), 30), Source("first", down, 1), Source("second", lambda: _plain(spark, d), 10)])


@query(f"SELECT channel, x, value FROM {SQL_SERIES} WHERE channel % 100 IN (3, 7) AND x >= 10 AND x < 20")
def fetch_reduced(spark, d):
    """Some channels of some stretch, written and read: the feature is the selection."""
    path = place(spark, "reduced.parquet")
    rows = series(spark, d)
    wanted = [r.channel for r in rows.select("channel").distinct().where("channel % 100 in (3, 7)").collect()]
    sources.registry.reduced(rows, wanted, 10, 20, path)
    return sources.read(spark, path, columns=["channel", "x", "value"])


@query(f"SELECT channel, x, value FROM {SQL_SERIES} WHERE x >= 8 AND x < 24")
def fetch_pieces(spark, d):
    """A request over several files, each with a stretch of the data: files are found by name, joined, and cut to what was asked for."""
    from tidegauge.operators import series as S

    base = place(spark, "files")
    rows = series(spark, d)
    for start in range(0, 64, 16):
        sources.write(rows.where((F.col("x") >= start) & (F.col("x") < start + 16)), f"{base}/X-SERIES-{start}-16.parquet", format="parquet")
    found = sources.read(spark, [f"{base}/X-SERIES-{s}-16.parquet" for s in range(0, 64, 16) if s < 24 and s + 16 > 8])
    return S.crop_irregular(found, 8, 24).select("channel", "x", "value")


#: Spellings of units and the units meant.
SPELLINGS = [("counts", "ct"), ("Meters", "m"), ("volts", "V"), ("sec", "s"), ("hertz", "Hz"), ("undef", ""), ("kg", "kg"), ("strain", "strain")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SPELLINGS) + ") t(name, unit)")
def unit_spellings(spark, d):
    return spark.createDataFrame([(a, channels.parse_unit(a)) for a, _ in SPELLINGS], "name string, unit string")


@query("SELECT event_id, value, value * 2 AS doubled FROM events WHERE value * 2 > 30")
def read_derived_where(spark, d):
    """A column that the file doesn't have, derived as it is read, and a condition on it."""
    rows = back(_plain(spark, d), "events.parquet")
    return rows.withColumn("doubled", F.col("value") * 2).where("doubled > 30").select("event_id", "value", "doubled")
