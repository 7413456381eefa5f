"""Filters, event rates, clusters, derived columns, times and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import derived, filters, gpstime, names
from tidegauge.operators import events as E
from tidegauge.operators import segments as S
from tidegauge.plans.registry import DAYS, SQL_EVENTS, SQL_SEGMENTS, T0, events, query, r6, segments, table

END = T0 + DAYS * 86400


def _columns(df):
    return df.select("event_id", "event_type", "value")


@query("SELECT event_id, event_type, value FROM events WHERE value > 50")
def filter_simple(spark, d):
    return _columns(filters.where(events(spark, d), "value > 50"))


@query("SELECT event_id, event_type, value FROM events WHERE 20 <= value AND value < 30.5")
def filter_range(spark, d):
    return _columns(filters.where(events(spark, d), "20 <= value < 30.5"))


@query("SELECT event_id, event_type, value FROM events WHERE 100 < value")
def filter_reversed(spark, d):
    return _columns(filters.where(events(spark, d), "100 < value"))


@query("SELECT event_id, event_type, value FROM events WHERE value >= 10 AND event_type = 'click' AND user_id != 8")
def filter_multi(spark, d):
    return _columns(filters.where(events(spark, d), "value >= 10 and event_type == 'click'", ["user_id != 8"]))


@query("SELECT event_id, event_type, value FROM events WHERE value * user_id > 2000")
def filter_callable(spark, d):
    return _columns(filters.where(events(spark, d), (("value", "user_id"), lambda a, b, limit: a * b > limit, 2000)))


@query("SELECT event_id, value FROM events WHERE value < 5 ORDER BY value DESC")
def read_columns_where(spark, d):
    from tidegauge.sources import read

    return read(spark, f"{d}/events.parquet", columns=["event_id", "value"], where="value < 5")


@query(f"""
WITH g AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {SQL_SEGMENTS} WHERE flag = 'signup' AND s < e),
i AS (SELECT s, e, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM g),
c AS (SELECT min(s) AS s, max(e) AS e FROM i GROUP BY k),
h AS (SELECT least(floor((t - {T0}) / 3600.0), {DAYS * 24 - 1})::BIGINT AS bin, count(*) AS n FROM {SQL_EVENTS} v
      WHERE value > 50 AND t BETWEEN {T0} AND {END} AND EXISTS (SELECT 1 FROM c WHERE c.s <= v.t AND v.t < c.e) GROUP BY 1)
SELECT b.bin, ({T0} + b.bin * 3600)::DOUBLE AS time, coalesce(n, 0) / 3600.0 AS rate
FROM (SELECT unnest(range({DAYS * 24}))::BIGINT AS bin) b LEFT JOIN h ON h.bin = b.bin
""")
def flagship_rate(spark, d):
    """The hourly rate of loud events inside good time."""
    good = S.coalesce(segments(spark, d).where("flag = 'signup'"), coarse=86400.0)
    loud = filters.where(events(spark, d), "value > 50")
    return E.event_rate(S.in_segments(loud, good, "t", width=3600.0), 3600.0, time="t", start=T0, end=END)


def _rate_sql(stride: float, series: list[tuple[str, str]], n: int) -> str:
    parts = " UNION ALL ".join(f"SELECT '{name}' AS series, b.bin, ({T0} + b.bin * {stride})::DOUBLE AS time, count(e.t) FILTER (WHERE {cond}) / {stride} AS rate FROM (SELECT unnest(range({n}))::BIGINT AS bin) b LEFT JOIN (SELECT *, least(floor((t - {T0}) / {stride}), {n - 1})::BIGINT AS bin FROM {SQL_EVENTS} WHERE t BETWEEN {T0} AND {T0} + {n} * {stride}) e ON e.bin = b.bin GROUP BY b.bin" for cond, name in series)
    return parts


@query(_rate_sql(21600.0, [("true", "x")], DAYS * 4).replace("'x' AS series, ", ""))
def event_rate(spark, d):
    return E.event_rate(events(spark, d), 21600.0, time="t", start=T0, end=END)


@query(f"""
WITH m AS (SELECT event_type, min(t) AS s, max(t) AS e FROM {SQL_EVENTS} GROUP BY 1),
v AS (SELECT m.event_type, s, ceil((e - s) / 86400.0) AS n FROM m),
h AS (SELECT v.event_type, least(floor((t - s) / 86400.0), n - 1)::BIGINT AS bin, count(*) AS c FROM {SQL_EVENTS} x JOIN v ON v.event_type = x.event_type GROUP BY 1, 2)
SELECT g.event_type, g.bin, s + g.bin * 86400.0 AS time, coalesce(c, 0) / 86400.0 AS rate
FROM (SELECT event_type, s, unnest(range(n::BIGINT))::BIGINT AS bin FROM v) g LEFT JOIN h ON h.event_type = g.event_type AND h.bin = g.bin
""")
def event_rate_by_type(spark, d):
    return E.event_rate(events(spark, d), 86400.0, time="t", by=["event_type"])


def _binned(spark, d, bins, operator=">="):
    return E.binned_event_rates(events(spark, d), 86400.0, E.value_bins("value", bins, operator), time="t", start=T0, end=END)


@query(_rate_sql(86400.0, [("value >= 10", "value >= 10"), ("value >= 100", "value >= 100")], DAYS))
def binned_rate_ge(spark, d):
    return _binned(spark, d, [10, 100])


@query(_rate_sql(86400.0, [("value >= 0 AND value < 10", "value in (0, 10)"), ("value >= 10 AND value < 100", "value in (10, 100)")], DAYS))
def binned_rate_in(spark, d):
    return _binned(spark, d, [0, 10, 100], "in")


@query(_rate_sql(86400.0, [("value >= 0 AND value < 50", "value >= (0, 50)"), ("value >= 20 AND value < 80", "value >= (20, 80)")], DAYS))
def binned_rate_tuple(spark, d):
    return _binned(spark, d, [(0, 50), (20, 80)])


@query("""SELECT b AS bin, 0.0 + 500.0 * b / 20 AS lo, 0.0 + 500.0 * (b + 1) / 20 AS hi, count(value) AS count
FROM (SELECT unnest(range(20))::BIGINT AS b) LEFT JOIN events ON value BETWEEN 0 AND 500 AND least(floor((value - 0) / 500 * 20), 19) = b GROUP BY b""")
def hist_linear(spark, d):
    return E.histogram(events(spark, d), "value", 20, 0, 500)


@query("""WITH e AS (SELECT least(floor((log10(value) - log10(0.01)) / (log10(1000.0) - log10(0.01)) * 10), 9)::BIGINT AS b FROM events WHERE value BETWEEN 0.01 AND 1000)
SELECT g.b AS bin, count(e.b) AS count FROM (SELECT unnest(range(10))::BIGINT AS b) g LEFT JOIN e ON e.b = g.b GROUP BY g.b""")
def hist_log(spark, d):
    return E.histogram(events(spark, d), "value", 10, 0.01, 1000, log=True).select("bin", "count")


SQL_CLUSTER = """
WITH g AS (SELECT *, CASE WHEN t - lag(t) OVER (%(part)s ORDER BY t, event_id) <= %(window)s THEN 0 ELSE 1 END AS n FROM {e}),
c AS (SELECT *, sum(n) OVER (%(part)s ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY %(key)s k ORDER BY value DESC, t, event_id) AS i FROM c)
SELECT event_id, user_id, value FROM r WHERE i = 1""".replace("{e}", SQL_EVENTS)


@query(SQL_CLUSTER % {"part": "", "window": 120, "key": ""})
def cluster(spark, d):
    """Chains over the whole table, through daily stretches."""
    return E.cluster(events(spark, d), "t", "value", 120, tie=["event_id"], coarse=86400.0).select("event_id", "user_id", "value")


@query(SQL_CLUSTER % {"part": "PARTITION BY user_id", "window": 86400, "key": "user_id,"})
def cluster_by_key(spark, d):
    return E.cluster(events(spark, d), "t", "value", 86400, by=["user_id"], tie=["event_id"]).select("event_id", "user_id", "value")


def _masses(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("mass1"), (F.col("p_retailprice") / 100).alias("mass2"), F.col("p_retailprice").alias("snr"), (F.col("p_size") / 10).alias("chisq"))


@query("SELECT p_partkey, p_size + p_retailprice / 100 AS mtotal FROM part")
def derived_mtotal(spark, d):
    return derived.with_derived(_masses(spark, d), ["p_partkey", "mtotal"])


@query("SELECT p_partkey, round(pow(p_size * (p_retailprice / 100), 0.6) / pow(p_size + p_retailprice / 100, 0.2), 6) + 0.0 AS mchirp FROM part")
def derived_mchirp(spark, d):
    return derived.with_derived(_masses(spark, d), ["p_partkey", "mchirp"]).withColumn("mchirp", r6(F.col("mchirp")))


@query("SELECT p_partkey, round(CASE WHEN p_size / 10.0 > 1 THEN p_retailprice * pow(0.5 * (1 + pow(p_size / 10.0, 3)), -1 / 6.0) ELSE p_retailprice END, 6) + 0.0 AS new_snr FROM part")
def derived_new_snr(spark, d):
    return derived.with_derived(_masses(spark, d), ["p_partkey", "new_snr"]).withColumn("new_snr", r6(F.col("new_snr")))


@query("SELECT p_partkey, round(pow(p_retailprice, 2) / pow(p_size / 10.0, 1), 4) AS snr_chi, round(1e9 * pow(p_size / 10.0, 1) / pow(p_retailprice, 2), 4) AS chi_snr FROM part")
def derived_snr_chi(spark, d):
    out = derived.with_derived(_masses(spark, d), ["p_partkey", "snr_chi", "chi_snr"])
    return out.withColumns({"snr_chi": F.round("snr_chi", 4), "chi_snr": F.round(F.col("chi_snr") * 1e9, 4)})


@query("SELECT l_orderkey, l_linenumber, l_orderkey + l_discount AS gpstime FROM lineitem")
def derived_gpstime(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("gps_start"), F.col("l_discount").alias("gps_offset"))
    return derived.with_derived(rows, ["l_orderkey", "l_linenumber", "gpstime"])


LEAPS = " + ".join(f"(CASE WHEN %s >= epoch_us(TIMESTAMP '{x}') THEN 1 ELSE 0 END)" for x in gpstime.LEAP_DAYS)


@query("SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 - 315964800 + (" + LEAPS.replace("%s", "epoch_us(o_orderdate)") + ") AS gps FROM orders")
def to_gps(spark, d):
    return table(spark, d, "orders").select("o_orderkey", gpstime.to_gps(F.col("o_orderdate")).alias("gps"))


@query("SELECT o_orderkey, epoch_us(o_orderdate) AS us FROM orders")
def from_gps(spark, d):
    """There and back."""
    gps = gpstime.to_gps(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(gpstime.from_gps(gps, on_leap="null")).alias("us"))


@query("SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate)) AS us FROM orders")
def parse_time(spark, d):
    text = F.date_format("o_orderdate", "MMM d yyyy")
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(gpstime.parse_time(text)).alias("us"))


@query("""SELECT event_id, (epoch_us((ts AT TIME ZONE 'UTC') AT TIME ZONE CASE WHEN event_id % 2 = 0 THEN 'America/Chicago' ELSE 'Europe/Rome' END) - epoch_us(ts))::BIGINT // 1000000 AS tz_offset FROM events""")
def timezone_offset(spark, d):
    ifo = F.when(F.col("event_id") % 2 == 0, "L1").otherwise("V1")
    return events(spark, d).select("event_id", gpstime.timezone_offset(ifo, F.col("ts")).alias("tz_offset"))


@query("SELECT event_id, floor(t / 60)::BIGINT * 60 AS start, ceil((t + value) / 60)::BIGINT * 60 AS \"end\" FROM " + SQL_EVENTS)
def minute_trend(spark, d):
    s, e = derived.minute_trend(F.col("t"), F.col("t") + F.col("value"))
    return events(spark, d).select("event_id", s.alias("start"), e.alias("end"))


@query("SELECT event_id, pow(2.0, round_even(x, 0)) AS nearest, pow(2.0, floor(x)) AS lower, pow(2.0, ceil(x)) AS upper FROM (SELECT event_id, CASE WHEN abs(log2(value) - round(log2(value))) < 1e-9 THEN round(log2(value)) ELSE log2(value) END AS x FROM events)")
def round_to_power(spark, d):
    v = F.col("value")
    return events(spark, d).select("event_id", *[derived.round_to_power(v, 2, w).alias(w or "nearest") for w in (None, "lower", "upper")])


@query("SELECT event_id, CAST(trunc(value * 16) AS INTEGER) AS n FROM events")
def seconds_to_samples(spark, d):
    return events(spark, d).select("event_id", derived.seconds_to_samples(F.col("value"), F.lit(16.0)).alias("n"))


CHANNEL = "concat('X', event_id % 9, ':', upper(event_type), '-', 'SUB', user_id % 7, '_SIGNAL_', user_id, CASE WHEN event_id % 3 = 0 THEN '.mean' ELSE '' END, CASE WHEN event_id % 3 = 0 THEN ',m-trend' ELSE '' END)"


def _channels(spark, d):
    return events(spark, d).select("event_id", F.expr(CHANNEL).alias("name"))


@query(f"""SELECT event_id, 'X' || event_id % 9 AS ifo, upper(event_type) AS system, 'SUB' || user_id % 7 AS subsystem, 'SIGNAL_' || user_id AS signal,
CASE WHEN event_id % 3 = 0 THEN 'mean' END AS trend, CASE WHEN event_id % 3 = 0 THEN 'm-trend' END AS type FROM events""")
def channel_parse(spark, d):
    return _channels(spark, d).select("event_id", names.channel_parts(F.col("name")).alias("p")).select("event_id", "p.*")


@query(f"SELECT event_id, name FROM (SELECT *, {CHANNEL} AS name FROM events) WHERE regexp_matches(name, 'CLICK|VIEW') AND user_id >= 10 AND user_id < 40")
def channel_sieve(spark, d):
    rows = events(spark, d).withColumn("name", F.expr(CHANNEL))
    return names_sieve(rows, name="CLICK|VIEW", rate="user_id", rates=(10, 40)).select("event_id", "name")


def names_sieve(df, *, name=None, rate=None, rates=None, exact=False, **others):
    """Channels by name (a regex, or exact), by a rate in [lo, hi), and by equal attributes."""
    cond = F.lit(True)
    if name is not None:
        cond = cond & (F.col("name") == name if exact else F.col("name").rlike(name))
    if rates is not None:
        cond = cond & (F.col(rate) >= rates[0]) & (F.col(rate) < rates[1])
    for k, v in others.items():
        cond = cond & (F.col(k) == v)
    return df.where(cond)


@query(f"SELECT event_id, replace(name, '_', '\\_') AS tex, CASE WHEN event_id % 2 = 0 THEN name ELSE name || ',rds' END AS server FROM (SELECT *, {CHANNEL} AS name FROM events)")
def channel_names(spark, d):
    n = F.col("name")
    kind = F.when(F.col("event_id") % 2 == 0, "raw").otherwise("rds")
    return _channels(spark, d).select("event_id", names.tex_name(n).alias("tex"), names.server_name(n, kind).alias("server"))


@query("SELECT event_id, 'L' || user_id % 3 AS ifo, 'DMT-' || upper(event_type) AS tag, (user_id % 5)::INTEGER AS version FROM events")
def flag_name(spark, d):
    name = F.expr("concat('L', user_id % 3, ':DMT-', upper(event_type), ':', user_id % 5)")
    return events(spark, d).select("event_id", *[names.flag_part(name, p).alias(p) for p in ("ifo", "tag", "version")])


@query("SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY user_id")
def unique_first(spark, d):
    """Distinct values with the place of their first appearance."""
    return events(spark, d).groupBy("user_id").agg(F.min("event_id").alias("first_seen"))


@query("SELECT user_id, event_type, value FROM events WHERE value >= 10 AND event_type = 'view' ORDER BY value")
def sql_builder(spark, d):
    """A built SELECT over a registered view."""
    events(spark, d).createOrReplaceTempView("built_events")
    return spark.sql(filters.sql_query("built_events", ["user_id", "event_type", "value"], where=["value >= 10", "event_type == 'view'"], order_by="value"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value, round(median(value), 6) AS median_value FROM events GROUP BY event_type")
def table_group(spark, d):
    """Grouped reductions of a table; deviations are of the population."""
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.stddev_pop("value"), 6).alias("std_value"), F.round(F.median("value"), 6).alias("median_value"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'event' || event_id AS name FROM events")
def catalogue_json(spark, d):
    """Rows of an event catalogue: a JSON document whose keys are events."""
    from tidegauge.sources.catalogue import rows_of

    docs = events(spark, d).select(F.format_string('{"events": {"event%d": %s}}', F.col("event_id"), F.col("props")).alias("text"))
    return rows_of(docs, "text", "k long").select(F.substring("name", 6, 20).cast("long").alias("event_id"), "k", "name")


def columns_bits(spark, d):
    return events(spark, d).select(F.col("event_id").alias("value"), "event_id")


@query("SELECT event_id, [((event_id >> 0) & 1) = 1, ((event_id >> 1) & 1) = 1, ((event_id >> 2) & 1) = 1, ((event_id >> 3) & 1) = 1]::VARCHAR AS flags FROM events")
def bits_expand(spark, d):
    text = F.concat(F.lit("["), F.array_join(F.transform(derived.bits(F.col("value"), 4), lambda b: b.cast("string")), ", "), F.lit("]"))
    return columns_bits(spark, d).select("event_id", text.alias("flags"))
