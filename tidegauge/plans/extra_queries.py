"""Merges, products, similarity and catalogue queries."""

from __future__ import annotations



from pyspark.sql import functions as F

from tidegauge.operators import kernels as K
from tidegauge.operators import products
from tidegauge.operators import series as X
from tidegauge.plans.event_queries import CHANNEL
from tidegauge.plans.registry import SQL_EVENTS, SQL_SERIES, T0, events, query, r6, samples, series, table
from tidegauge.plans.segment_queries import KA, KB, A, B, _flags, kinds, sql_sweep
from tidegauge.plans.series_queries import DFT, SQL_2D, _plane
from tidegauge.sources import flags as FL


@query(f"SELECT channel, CASE WHEN idx >= 40 THEN idx + 5 ELSE idx END AS idx, CASE WHEN idx >= 40 THEN x + 5 ELSE x END AS x, value FROM {SQL_SERIES} UNION ALL SELECT vec_id, k + 40, k + 40.0, 7.0 FROM embeddings, range(5) r(k)")
def series_join_pieces(spark, d):
    """Three pieces a channel, the last behind a gap of five samples."""
    s = series(spark, d)
    piece = F.when(F.col("idx") < 10, 2).when(F.col("idx") < 40, 0).otherwise(1)
    pieces = s.withColumn("piece", piece).withColumn("x", F.when(F.col("idx") >= 40, F.col("x") + 5).otherwise(F.col("x")))
    return X.join_pieces(pieces, dx=1.0, fill=7.0)


@query(f"SELECT channel, idx + 3 AS idx, x, value FROM {SQL_SERIES} UNION ALL SELECT vec_id, CASE WHEN k < 3 THEN k ELSE k + 64 END, CASE WHEN k < 3 THEN k - 3.0 ELSE k + 61.0 END, 0.5 FROM embeddings, range(9) r(k)")
def series_pad_to(spark, d):
    return X.pad_to(series(spark, d), -3.4, 70.2, dx=1.0, fill=0.5)


@query(f'SELECT 0.0::DOUBLE AS start, 64.0::DOUBLE AS "end"')
def series_span(spark, d):
    return X.span(series(spark, d))


@query(f"SELECT channel, idx, round(value * (channel % 5 + 1) + 0.25, 6) + 0.0 AS value FROM {SQL_SERIES}")
def series_scaled(spark, d):
    s = series(spark, d)
    return s.select("channel", "idx", r6(X.scale(F.col("value"), F.col("channel") % 5 + 1, F.lit(0.25))).alias("value"))


@query(f"SELECT channel, (idx // 8)::BIGINT AS step, min(value) AS low, round(avg(value), 6) + 0.0 AS mean, max(value) AS high FROM {SQL_SERIES} GROUP BY 1, 2")
def min_mean_max(spark, d):
    out = X.min_mean_max(series(spark, d), 8)
    return out.select("channel", "step", "low", r6(F.col("mean")).alias("mean"), "high")


@query(f"SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY ti, fi) - 1 AS idx, value FROM {SQL_2D}")
def flatten(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("channel").orderBy("ti", "fi")
    return _plane(spark, d).select("channel", (F.row_number().over(w) - 1).cast("long").alias("idx"), "value")


@query(f"SELECT channel, value FROM {SQL_2D} WHERE ti = 3 AND fi = 11")
def value_at_2d(spark, d):
    return _plane(spark, d).where("ti = 3 and fi = 11").select("channel", "value")


@query(f"SELECT channel, fi, value FROM {SQL_2D} WHERE ti = 2")
def spectrogram_row(spark, d):
    return _plane(spark, d).where("ti = 2").select("channel", "fi", "value")


@query(f"SELECT event_id, value / 2 AS w, t - value / 4 AS x0, t - value / 4 + value / 2 AS x1, user_id::DOUBLE AS y0, user_id::DOUBLE + 1 AS y1 FROM {SQL_EVENTS}")
def tile_corners(spark, d):
    e = events(spark, d).withColumn("w", F.col("value") / 2)
    c = products.tile_corners(F.col("t"), F.col("user_id") + 0.5, F.col("w"), F.lit(1.0))
    return e.select("event_id", "w", c.alias("c")).select("event_id", "w", "c.*")


@query(f"SELECT channel, fi, round(20 * log10(sqrt(re * re + im * im)), 4) AS magnitude, round(degrees(atan2(im, re)), 2) + 0.0 AS phase FROM {DFT} WHERE fi BETWEEN 1 AND 31")
def bode_series(spark, d):
    from tidegauge.operators import spectral as P

    z = P.fft(samples(spark, d), "samples").where("fi between 1 and 31")
    z = z.select("channel", "fi", products.bode(F.col("re"), F.col("im")).alias("b"))
    return z.select("channel", "fi", F.round("b.magnitude", 4).alias("magnitude"), (F.round("b.phase", 2) + 0.0).alias("phase"))


@query()
def bode_filter(spark, d):
    return products.filter_table(spark, K.lowpass(8, 64), [float(f) for f in range(32)], fs=64.0)


@query(f"SELECT user_id, CASE WHEN s >= 4 * 31557600 THEN 'years' WHEN s >= 4 * 604800 THEN 'weeks' WHEN s >= 4 * 86400 THEN 'days' WHEN s >= 4 * 3600 THEN 'hours' WHEN s >= 4 * 60 THEN 'minutes' ELSE 'seconds' END AS unit FROM (SELECT user_id, (max(t) - min(t)) / (1 + user_id * 50) AS s FROM {SQL_EVENTS} GROUP BY user_id)")
def axis_unit(spark, d):
    s = events(spark, d).groupBy("user_id").agg(((F.max("t") - F.min("t")) / (1 + F.col("user_id") * 50)).alias("s"))
    return s.select("user_id", products.axis_unit(F.col("s")).alias("unit"))


@query("""WITH n AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query, n.vec_id AS id, list_dot_product(q.v, n.v) AS c FROM n q JOIN n ON n.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, id, round(c, 6) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, id) <= 10""")
def similar_topk(spark, d):
    v = table(spark, d, "embeddings")
    out = products.similar(v, v.where("vec_id % 50 = 0"), id_col="vec_id", vector_col="embedding", k=10)
    return out.withColumn("cosine", F.round("cosine", 6))


R0, R1, R2, R3 = T0 + 100000, T0 + 700000, T0 + 650000, T0 + 1200000
ASKED = f"(SELECT flag, {R0}::DOUBLE AS s, {R3}::DOUBLE AS e FROM (SELECT DISTINCT flag FROM {KA}))"


@query(kinds(sql_sweep({"a": KA, "w": ASKED}, "a > 0 AND w > 0"), sql_sweep({"a": A, "w": ASKED}, "a > 0 AND w > 0")))
def flag_query(spark, d):
    """Flags cut to two overlapping stretches that were asked for."""
    asked = spark.createDataFrame([(float(R0), float(R1)), (float(R2), float(R3))], "start double, end double")
    return FL.query_flags(_flags(spark, d)[0], asked)


@query("SELECT flag, kind, start, \"end\" FROM (" + kinds(KA, A) + ") UNION ALL SELECT flag, kind, start, \"end\" FROM (" + kinds(KB, B) + ")")
def flag_merge(spark, d):
    return FL.merge_flags(list(_flags(spark, d)), names=["u0", "u1", "u2", "u3"])


@query("""SELECT name, rate, type FROM (SELECT c_name AS name, (c_custkey % 16)::DOUBLE AS rate, c_mktsegment AS type FROM customer) WHERE (name LIKE 'Customer#0000000%' OR name LIKE '%77') AND rate = 4 AND type IN ('MACHINERY', 'BUILDING')""")
def channel_search(spark, d):
    cat = table(spark, d, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 16).cast("double").alias("rate"), F.col("c_mktsegment").alias("type"))
    return FL.find_channels(cat, ["Customer#0000000*", "*77"], rate=4.0, kinds=["MACHINERY", "BUILDING"], unique=True)


@query(f"SELECT min(event_id) AS first_index FROM (SELECT event_id, {CHANNEL} AS name FROM events) WHERE name = (SELECT {CHANNEL} FROM events WHERE event_id = 77)")
def channel_find(spark, d):
    """The index of the first channel of exactly one name."""
    c = events(spark, d).select("event_id", F.expr(CHANNEL).alias("name"))
    wanted = c.where("event_id = 77").select("name")
    return c.join(F.broadcast(wanted), "name", "left_semi").agg(F.min("event_id").alias("first_index"))


@query("SELECT list_sort(list(DISTINCT 'X' || event_id % 9))::VARCHAR AS ifos FROM events")
def channel_ifos(spark, d):
    from tidegauge.functions.names import channel_part

    c = events(spark, d).select(F.expr(CHANNEL).alias("name"))
    return c.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set(channel_part(F.col("name"), "ifo"))), ", "), F.lit("]")).alias("ifos"))


@query("SELECT i AS idx, 5.0::DOUBLE + i * 0.25::DOUBLE AS x FROM range(10) r(i)")
def axis_define(spark, d):
    return X.axis(spark, 5.0, 0.25, 10)


@query("SELECT a.event_id, CASE WHEN abs(b.t - (a.t + 0.0)) < pow(2, -18) THEN 1 ELSE 0 END AS contiguous FROM " + SQL_EVENTS + " a JOIN " + SQL_EVENTS + " b ON b.event_id = a.event_id + (a.event_id % 2)")
def is_contiguous(spark, d):
    e = events(spark, d).select("event_id", "t")
    b = e.select(F.col("event_id").alias("other"), F.col("t").alias("start"))
    return e.join(b, F.col("other") == F.col("event_id") + F.col("event_id") % 2).select("event_id", X.is_contiguous(F.col("t"), F.col("start")).alias("contiguous"))


@query(f"SELECT o_orderkey, o_totalprice, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 48")
def table_join_left(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 48")
    o = table(spark, d, "orders")
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", "o_totalprice", "l_linenumber")


@query(f"SELECT channel, idx, sum(value) OVER (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING)::DECIMAL(18, 4)::DOUBLE AS value FROM (SELECT channel, idx, round(value, 4)::DECIMAL(18, 4) AS value FROM {SQL_SERIES})")
def cumulative_sum(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("channel").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    s = series(spark, d).withColumn("value", F.round("value", 4).cast("decimal(18,4)"))
    return s.select("channel", "idx", F.sum("value").over(w).cast("double").alias("value"))


@query(f"SELECT channel, arg_max(idx, value) AS at_max, arg_min(idx, value) AS at_min, round(exp(avg(ln(abs(value) + 1))), 6) AS geometric FROM {SQL_SERIES} GROUP BY channel")
def extremes(spark, d):
    return series(spark, d).groupBy("channel").agg(F.max_by("idx", "value").alias("at_max"), F.min_by("idx", "value").alias("at_min"), F.round(F.exp(F.avg(F.log(F.abs("value") + 1))), 6).alias("geometric"))


@query(f"SELECT event_id, t - 315964800 + 18 AS gps, epoch_us(ts) AS us FROM {SQL_EVENTS}")
def tconvert(spark, d):
    """Dates to GPS seconds, and numbers back to dates."""
    from tidegauge.functions.gpstime import from_gps, to_gps

    g = to_gps(F.col("ts"))
    return events(spark, d).select("event_id", g.alias("gps"), F.unix_micros(from_gps(g, on_leap="null")).alias("us"))



