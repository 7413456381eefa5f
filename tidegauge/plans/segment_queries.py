"""Interval algebra, flags, memberships and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import segments as S
from tidegauge.plans.registry import SQL_EVENTS, SQL_SEGMENTS, T0, events, query, segments, table
from tidegauge.sources import manifest as M

#: Two families of segments by user group (key ``flag``), one from the events, one behind them; known: two of each three days.
A = f"(SELECT 'u' || user_id % 4 AS flag, t AS s, t + 30 * value AS e FROM {SQL_EVENTS})"
B = f"(SELECT 'u' || user_id % 4 AS flag, t + 900 AS s, t + 900 + 50 * value AS e FROM {SQL_EVENTS})"
K = f"(SELECT 'u' || k AS flag, ({T0} + d * 259200 + k * 7200)::DOUBLE AS s, ({T0} + d * 259200 + 172800 + o)::DOUBLE AS e FROM range(4) r(k), range(10) q(d))"


def _side(spark, d, which):
    start = F.col("t") + 900 if which else F.col("t")
    return events(spark, d).select(F.concat(F.lit("u"), F.col("user_id") % 4).alias("flag"), start.alias("start"), (start + (50 if which else 30) * F.col("value")).alias("end"))


def _known(spark, extra=0):
    r = spark.range(4).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("d"))
    return r.select(F.concat(F.lit("u"), "k").alias("flag"), (F.lit(T0) + F.col("d") * 259200 + F.col("k") * 7200).cast("double").alias("start"), (F.lit(T0) + F.col("d") * 259200 + 172800 + extra).cast("double").alias("end"))


def _flags(spark, d):
    return S.as_flags(_known(spark), _side(spark, d, 0)), S.as_flags(_known(spark, 3600), _side(spark, d, 1))


KA, KB = K.replace("+ o)", "+ 0)"), K.replace("+ o)", "+ 3600)")


def sql_coalesce(rows: str, keys: str = "flag") -> str:
    """Islands of (keys, s, e)."""
    return f"""(WITH w AS (SELECT {keys}, s, e, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {rows} WHERE s < e),
i AS (SELECT {keys}, s, e, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM w)
SELECT {keys}, min(s) AS s, max(e) AS e FROM i GROUP BY {keys}, k)"""


def sql_sweep(frames: dict[str, str], keep: str, keys: str = "flag") -> str:
    """Stretches where ``keep`` holds of the depths of named frames, from all boundaries."""
    rows = " UNION ALL ".join(f"SELECT {keys}, s AS p, {', '.join(('1' if n == m else '0') + f' AS {m}' for m in frames)} FROM {f} WHERE s < e UNION ALL SELECT {keys}, e, {', '.join(('-1' if n == m else '0') for m in frames)} FROM {f} WHERE s < e" for n, f in frames.items())
    sums = ", ".join(f"sum(sum({m})) OVER (PARTITION BY {keys} ORDER BY p) AS {m}" for m in frames)
    return sql_coalesce(f"(SELECT {keys}, p AS s, q AS e FROM (SELECT {keys}, p, lead(p) OVER (PARTITION BY {keys} ORDER BY p) AS q, {sums} FROM ({rows}) GROUP BY {keys}, p) WHERE q IS NOT NULL AND ({keep}))", keys)


def out(rows: str, keys: str = "flag") -> str:
    return f'SELECT {keys}, s AS start, e AS "end" FROM {rows}'


def kinds(known: str, active: str) -> str:
    return f"""SELECT flag, 'known' AS kind, s AS start, e AS "end" FROM {known} UNION ALL SELECT flag, 'active', s, e FROM {active}"""


@query(out(sql_coalesce(A)))
def seg_coalesce(spark, d):
    return S.coalesce(_side(spark, d, 0), ["flag"])


@query(out(sql_coalesce(f"(SELECT 1 AS one, s, e FROM {SQL_SEGMENTS})", "one"), "one").replace("one, s AS", "s AS"))
def seg_coalesce_all(spark, d):
    """Without keys, through stretches of an hour."""
    return S.coalesce(segments(spark, d), coarse=3600.0)


@query(out(sql_coalesce(f"(SELECT * FROM {A} UNION ALL SELECT * FROM {B})")))
def seg_union(spark, d):
    return S.union(_side(spark, d, 0), _side(spark, d, 1), ["flag"])


@query(out(sql_sweep({"a": A, "b": B}, "a > 0 AND b > 0")))
def seg_intersect(spark, d):
    return S.intersection(_side(spark, d, 0), _side(spark, d, 1), ["flag"])


@query(out(sql_sweep({"a": A, "b": B}, "a > 0 AND b <= 0")))
def seg_diff(spark, d):
    return S.difference(_side(spark, d, 0), _side(spark, d, 1), ["flag"])


@query(out(sql_sweep({"a": A, "b": B}, "(a > 0) <> (b > 0)")))
def seg_xor(spark, d):
    return S.symmetric_difference(_side(spark, d, 0), _side(spark, d, 1), ["flag"])


@query(kinds(sql_sweep({"a": KA, "b": KB}, "a > 0 AND b > 0"), sql_sweep({"a": A, "b": B}, "a > 0 AND b > 0")))
def flag_and(spark, d):
    return S.flag_and(*_flags(spark, d))


@query(kinds(sql_coalesce(f"(SELECT * FROM {KA} UNION ALL SELECT * FROM {KB})"), sql_coalesce(f"(SELECT * FROM {A} UNION ALL SELECT * FROM {B})")))
def flag_or(spark, d):
    return S.flag_or(*_flags(spark, d))


@query(kinds(sql_sweep({"a": KA, "b": KB}, "a > 0 AND b > 0"), sql_sweep({"a": A, "b": B, "ka": KA, "kb": KB}, "a > 0 AND b <= 0 AND ka > 0 AND kb > 0")))
def flag_sub(spark, d):
    return S.flag_sub(*_flags(spark, d))


@query(kinds(sql_sweep({"a": KA, "b": KB}, "a > 0 AND b > 0"), sql_sweep({"a": A, "b": B}, "(a > 0) <> (b > 0)")))
def flag_xor(spark, d):
    return S.flag_xor(*_flags(spark, d))


@query(kinds(sql_coalesce(KA), sql_sweep({"a": A, "ka": KA}, "ka > 0 AND a <= 0")))
def flag_invert(spark, d):
    return S.flag_invert(_flags(spark, d)[0])


CLIPPED = sql_sweep({"a": A, "ka": KA}, "ka > 0 AND a > 0")


@query(kinds(sql_coalesce(KA), CLIPPED))
def flag_coalesce(spark, d):
    return S.flag_coalesce(_flags(spark, d)[0])


@query(kinds(f"(SELECT flag, s - 10 AS s, e + 25 AS e FROM {KA})", f"(SELECT flag, s - 10 AS s, e + 25 AS e FROM {A})"))
def flag_pad(spark, d):
    return S.flag_pad(_flags(spark, d)[0], -10, 25)


def _rounded(lo, hi):
    k, a = (f"(SELECT flag, {lo}(s)::DOUBLE AS s, {hi}(e)::DOUBLE AS e FROM {f})" for f in (KA, A))
    return kinds(sql_coalesce(k), sql_sweep({"a": a, "ka": k}, "ka > 0 AND a > 0"))


@query(_rounded("floor", "ceil"))
def flag_round_out(spark, d):
    return S.flag_round(_flags(spark, d)[0])


@query(_rounded("ceil", "floor"))
def flag_round_in(spark, d):
    return S.flag_round(_flags(spark, d)[0], inwards=True)


@query(kinds(KA, sql_coalesce(f"(SELECT flag, s + 300 AS s, e - 300 AS e FROM {sql_coalesce(A)})")))
def flag_contract(spark, d):
    return S.flag_contract(_flags(spark, d)[0], 300)


@query(kinds(KA, sql_coalesce(f"(SELECT flag, s - 300 AS s, e + 300 AS e FROM {sql_coalesce(A)})")))
def flag_protract(spark, d):
    return S.flag_protract(_flags(spark, d)[0], 300)


@query(f"SELECT flag, round(sum(e - s), 4) AS livetime FROM {CLIPPED} GROUP BY flag")
def flag_livetime(spark, d):
    flags = S.flag_coalesce(_flags(spark, d)[0])
    return S.livetime(S.kind(flags, "active"), ["flag"]).withColumn("livetime", F.round("livetime", 4))


@query(f'SELECT flag, min(s) AS start, max(e) AS "end" FROM {KA} GROUP BY flag')
def flag_extent(spark, d):
    return S.extent(S.kind(_flags(spark, d)[0], "known"), ["flag"])


@query(f"SELECT flag, count(*) FILTER (WHERE NOT ok) = 0 AS regular FROM (SELECT a.flag, EXISTS (SELECT 1 FROM {sql_coalesce(KA)} k WHERE k.flag = a.flag AND k.s <= a.s AND a.e <= k.e) AS ok FROM {A} a WHERE a.s < a.e) GROUP BY flag")
def flag_regular(spark, d):
    return S.flag_regular(_flags(spark, d)[0])


@query(kinds(sql_sweep({"a": KA, "b": KB}, "a > 0 AND b > 0"), sql_sweep({"a": KA, "b": KB, "c": f"(SELECT flag, s - 5 AS s, e + 5 AS e FROM {B})"}, "a > 0 AND b > 0 AND c > 0")))
def flag_populate(spark, d):
    mine, source = _flags(spark, d)
    padding = mine.select("flag").distinct().withColumns({"before": F.lit(-5.0), "after": F.lit(5.0)})
    return S.flag_populate(mine, source, padding)


GOOD = sql_coalesce(f"(SELECT * FROM {SQL_SEGMENTS} WHERE flag IN ('signup', 'view'))")


@query(f"SELECT event_id FROM {SQL_EVENTS} v WHERE EXISTS (SELECT 1 FROM {GOOD} g WHERE g.flag = 'view' AND g.s <= v.t AND v.t < g.e)")
def in_segments(spark, d):
    good = S.coalesce(segments(spark, d).where("flag = 'view'"), coarse=86400.0)
    return S.in_segments(events(spark, d), good, "t", width=1800.0).select("event_id")


@query(f"SELECT event_id FROM {SQL_EVENTS} v WHERE NOT EXISTS (SELECT 1 FROM {GOOD} g WHERE g.flag = 'view' AND g.s <= v.t AND v.t < g.e)")
def not_in_segments(spark, d):
    good = S.coalesce(segments(spark, d).where("flag = 'view'"), coarse=86400.0)
    return S.not_in_segments(events(spark, d), good, "t", width=1800.0).select("event_id")


@query(f"SELECT event_id, event_type FROM {SQL_EVENTS} v WHERE EXISTS (SELECT 1 FROM {sql_coalesce(SQL_SEGMENTS)} g WHERE g.flag = v.event_type AND g.s < v.t AND v.t - 1 >= g.s AND v.t - 1 < g.e)")
def in_segments_by_key(spark, d):
    """Events that follow an active second of their own type."""
    good = S.coalesce(segments(spark, d), ["flag"]).withColumnRenamed("flag", "event_type")
    rows = events(spark, d).withColumn("before", F.col("t") - 1)
    return S.in_segments(rows, good, "before", width=1800.0, keys=["event_type"]).select("event_id", "event_type")


@query(f"SELECT a.flag, a.s AS a_start, a.e AS a_end, b.s AS b_start, b.e AS b_end FROM {A} a JOIN {B} b ON a.flag = b.flag AND a.s < b.e AND b.s < a.e WHERE a.s < a.e AND b.s < b.e")
def overlap_join(spark, d):
    return S.overlap_join(_side(spark, d, 0), _side(spark, d, 1), width=3600.0, keys=["flag"])


@query(out(sql_coalesce(f"(SELECT 'active' AS kind, s, e FROM {A} UNION ALL SELECT 'known', s, e FROM {KA})", "kind"), "kind"))
def dict_union(spark, d):
    return S.all_union(_flags(spark, d)[0])


DEPTH = sql_coalesce(f"(SELECT flag || '/' || kind AS flag, s, e FROM (SELECT flag, 'active' AS kind, s, e FROM {A} UNION ALL SELECT flag, 'known', s, e FROM {KA}))")


@query(f"""WITH c AS (SELECT split_part(flag, '/', 2) AS kind, s, e FROM {DEPTH}),
b AS (SELECT kind, s AS p, 1 AS d FROM c UNION ALL SELECT kind, e, -1 FROM c),
r AS (SELECT kind, p, sum(sum(d)) OVER (PARTITION BY kind ORDER BY p) AS depth, lead(p) OVER (PARTITION BY kind ORDER BY p) AS q FROM b GROUP BY kind, p)
{out(sql_coalesce("(SELECT kind, p AS s, q AS e FROM r WHERE depth = 4 AND q IS NOT NULL)", "kind"), "kind")}""")
def dict_intersection(spark, d):
    return S.all_intersection(_flags(spark, d)[0])


def _asymmetric(spark, d):
    a, b = _flags(spark, d)
    return a.where("flag in ('u0', 'u1')"), b.where("flag in ('u1', 'u2')")


def _only(f: str, names: str) -> str:
    return f"(SELECT * FROM {f} WHERE flag IN ({names}))"


BOTH = kinds(sql_sweep({"a": _only(KA, "'u1'"), "b": _only(KB, "'u1'")}, "a > 0 AND b > 0"), sql_sweep({"a": _only(A, "'u1'"), "b": _only(B, "'u1'")}, "a > 0 AND b > 0"))


@query(f"{BOTH} UNION ALL {kinds(_only(KA, repr('u0')), _only(A, repr('u0')))}")
def dict_and_asym(spark, d):
    return S.dict_and(*_asymmetric(spark, d))


@query(
    kinds(sql_coalesce(f"(SELECT * FROM {_only(KA, repr('u1'))} UNION ALL SELECT * FROM {_only(KB, repr('u1'))})"), sql_coalesce(f"(SELECT * FROM {_only(A, repr('u1'))} UNION ALL SELECT * FROM {_only(B, repr('u1'))})"))
    + " UNION ALL " + kinds(_only(KA, "'u0'"), _only(A, "'u0'")) + " UNION ALL " + kinds(_only(KB, "'u2'"), _only(B, "'u2'"))
)
def dict_or(spark, d):
    return S.dict_or(*_asymmetric(spark, d))


@query(
    kinds(sql_sweep({"a": _only(KA, "'u1'"), "b": _only(KB, "'u1'")}, "a > 0 AND b > 0"), sql_sweep({"a": _only(A, "'u1'"), "b": _only(B, "'u1'"), "ka": _only(KA, "'u1'"), "kb": _only(KB, "'u1'")}, "a > 0 AND b <= 0 AND ka > 0 AND kb > 0"))
    + " UNION ALL " + kinds(_only(KA, "'u0'"), _only(A, "'u0'"))
)
def dict_sub(spark, d):
    return S.dict_sub(*_asymmetric(spark, d))


@query(
    kinds(sql_sweep({"a": _only(KA, "'u1'"), "b": _only(KB, "'u1'")}, "a > 0 AND b > 0"), sql_sweep({"a": _only(A, "'u1'"), "b": _only(B, "'u1'")}, "(a > 0) <> (b > 0)"))
    + " UNION ALL " + kinds(_only(KA, "'u0'"), _only(A, "'u0'"))
)
def dict_xor(spark, d):
    return S.dict_xor(*_asymmetric(spark, d))


R0, R1 = T0 + 400000, T0 + 1500000


@query(
    out(sql_coalesce(f"(SELECT 'X' || n.n_regionkey || ':' || n.n_name || ':' || v % 2 AS flag, greatest({T0} + v * 86400.0, {R0})::DOUBLE AS s, least(CASE WHEN v % 3 = 0 THEN 'inf'::DOUBLE ELSE {T0} + v * 86400.0 + 200000 END, {R1}) AS e FROM nation n, range(20) r(v) WHERE n.n_regionkey = 2 AND {T0} + v * 86400.0 < {R1} AND (v % 3 = 0 OR {T0} + v * 86400.0 + 200000 > {R0}))"))
)
def veto_clip(spark, d):
    """Veto definers of one detector, cut to a range; an end of 0 is open."""
    v = F.col("v")
    n = table(spark, d, "nation").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(19))))
    start = F.lit(T0) + v * 86400
    definers = n.select(F.concat(F.lit("X"), "n_regionkey").alias("ifo"), F.col("n_name").alias("name"), (v % 2).alias("version"), start.alias("start_time"), F.when(v % 3 == 0, 0).otherwise(start + 200000).alias("end_time"))
    return S.from_veto_definers(definers, R0, R1, "X2")


@query(kinds("(SELECT 'D1:' || s_name || ':' || s_nationkey % 3 AS flag, min(l_shipdate) AS s, max(l_shipdate) AS e FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)", "(SELECT 'D1:' || s_name || ':' || s_nationkey % 3 AS flag, l_shipdate AS s, l_shipdate + INTERVAL 1 DAY AS e FROM supplier JOIN lineitem ON l_suppkey = s_suppkey)").replace("s AS start", "epoch_us(s) AS start").replace('e AS "end"', 'epoch_us(e) AS "end"').replace("'active', s, e", "'active', epoch_us(s), epoch_us(e)"))
def segment_table_join(spark, d):
    """The three-table form of flags: definer with summary, definer with segment."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    line = table(spark, d, "lineitem")
    definers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("segment_def_id"), F.lit("D1").alias("ifos"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 3).alias("version"))
    summaries = line.groupBy(F.col("l_suppkey").alias("segment_def_id")).agg(F.min(us("l_shipdate")).alias("start_time"), F.max(us("l_shipdate")).alias("end_time"))
    rows = line.select(F.col("l_suppkey").alias("segment_def_id"), us("l_shipdate").alias("start_time"), (us("l_shipdate") + 86400 * 10**6).alias("end_time"))
    return S.from_segment_tables(definers, summaries, rows)


@query(f"""SELECT flag, row_number() OVER (PARTITION BY flag ORDER BY s, e)::INTEGER - 1 AS "index", s AS start, e AS "end", e - s AS duration FROM {sql_coalesce(A)}""")
def seg_table(spark, d):
    return S.to_table(S.coalesce(_side(spark, d, 0), ["flag"]), ["flag"])


FILES = "concat('/data/', upper(left(event_type, 1)), '-', upper(event_type), '_T', user_id % 3, '-', cast(floor(unix_micros(cast(ts as timestamp)) / 60000000) * 60 as bigint), '-', 60 * (1 + event_id % 3), '.gwf')"
SQL_FILES = "(SELECT *, s + 60 * (1 + event_id % 3) AS e, '/data/' || observatory || '-' || description || '-' || s::BIGINT || '-' || 60 * (1 + event_id % 3) || '.gwf' AS path FROM (SELECT event_id, upper(left(event_type, 1)) AS observatory, upper(event_type) || '_T' || user_id % 3 AS description, (floor(epoch_us(ts) / 60000000) * 60)::DOUBLE AS s FROM events))"


def _files(spark, d):
    return M.manifest(table(spark, d, "events").select(F.expr(FILES).alias("path")))


@query(f'SELECT path, observatory, description, s AS start, e AS "end" FROM {SQL_FILES}')
def manifest_parse(spark, d):
    return _files(spark, d)


@query(f"SELECT path FROM {SQL_FILES} WHERE s < {R1} AND e > {R0}")
def manifest_sieve(spark, d):
    return M.sieve(_files(spark, d), R0, R1).select("path")


@query(f'SELECT observatory, description, s AS start, e AS "end" FROM {sql_coalesce(SQL_FILES, "observatory, description")}')
def manifest_coverage(spark, d):
    return M.coverage(_files(spark, d))


@query(f"""WITH w AS (SELECT *, max(e) OVER (PARTITION BY observatory, description ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {SQL_FILES}),
r AS (SELECT observatory, description, s, e, sum(CASE WHEN s <= m THEN 0 ELSE 1 END) OVER (PARTITION BY observatory, description ORDER BY s, e ROWS UNBOUNDED PRECEDING) - 1 AS run FROM w)
SELECT observatory, description, run::BIGINT AS run, count(*) AS n, min(s) AS start, max(e) AS "end" FROM r GROUP BY ALL""")
def manifest_contiguous(spark, d):
    return M.contiguous(_files(spark, d)).groupBy("observatory", "description", "run").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


@query(f"SELECT observatory, description, arg_max(path, (e, s, path)) AS path FROM {SQL_FILES} GROUP BY ALL")
def manifest_latest(spark, d):
    return M.latest(_files(spark, d))


@query(f"SELECT DISTINCT observatory, description FROM {SQL_FILES} WHERE regexp_matches(description, 'VIEW|CLICK')")
def manifest_types(spark, d):
    return M.types(_files(spark, d), "VIEW|CLICK")


@query(f"""SELECT observatory, description, s AS start, e AS "end" FROM {sql_sweep({"w": f"(SELECT DISTINCT observatory, description, {R0}::DOUBLE AS s, {R1}::DOUBLE AS e FROM {SQL_FILES})", "f": SQL_FILES}, "w > 0 AND f <= 0", "observatory, description")}""")
def manifest_gaps(spark, d):
    files = _files(spark, d)
    wanted = files.select("observatory", "description").distinct().withColumns({"start": F.lit(float(R0)), "end": F.lit(float(R1))})
    return M.gaps(files, wanted)


@query(f"""WITH c AS (SELECT * FROM {sql_coalesce(SQL_FILES, "observatory, description")} WHERE s < {R1} AND e > {R0})
SELECT observatory, description, sum(least(e, {R1}) - greatest(s, {R0})) AS livetime, sum(least(e, {R1}) - greatest(s, {R0})) >= {R1 - R0} AS gapless FROM c GROUP BY ALL""")
def manifest_best_type(spark, d):
    return M.best_type(_files(spark, d), R0, R1)


@query("SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def coinc_join(spark, d):
    """The join of coincident triggers on their id."""
    from tidegauge.sources.tables import coincident_triggers

    a = table(spark, d, "orders").withColumn("coinc_event_id", F.col("o_orderkey"))
    b = table(spark, d, "lineitem").withColumn("coinc_event_id", F.col("l_orderkey")).where("l_quantity > 45")
    return coincident_triggers(a, b, ["o_orderkey", "o_totalprice", "l_linenumber", "l_quantity"])


@query("SELECT event_id AS id, value, NULL::VARCHAR AS name, 'e' AS channel FROM events UNION ALL SELECT c_custkey, NULL, c_name, 'c' FROM customer")
def multi_file_outer_union(spark, d):
    from tidegauge.sources import merge

    a = events(spark, d).select(F.col("event_id").alias("id"), "value", F.lit("e").alias("channel"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("c").alias("channel"))
    return merge([a, b])


@query("SELECT event_id, value, event_type AS channel FROM events WHERE event_type IN ('view', 'click')")
def stack_channels(spark, d):
    from tidegauge.sources.tables import stack_channels as stack

    e = events(spark, d)
    return stack({k: e.where(F.col("event_type") == k).select("event_id", "value") for k in ("view", "click")})


@query("SELECT 'geo' || strftime(m, '%Y%m') AS name FROM (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2024-03-05', INTERVAL 1 MONTH)) AS m)")
def month_names(spark, d):
    from tidegauge.sources.tables import months

    return months("2023-11-20", "2024-03-05", spark)


@query(f"""SELECT event_id, s + value AS gpstime FROM (SELECT event_id, event_id % 5 AS p, t AS s, value FROM {SQL_EVENTS}) x
JOIN (SELECT unnest(range(5)) AS p) q ON q.p = x.p WHERE p < 3 AND s >= greatest({T0} + p * 300000, {R0}) AND s < least({T0} + p * 300000 + 900000, {R1})""".replace("WHERE p <", "WHERE x.p <").replace("+ p *", "+ x.p *"))
def process_triggers(spark, d):
    """Triggers of the processes that overlap a range, cut to both."""
    from tidegauge.sources.tables import process_triggers as cut

    p = spark.range(5).select(F.col("id").alias("process_id"), F.when(F.col("id") < 3, "good").otherwise("bad").alias("channel"), (F.lit(T0) + F.col("id") * 300000).alias("gps_start"), (F.lit(T0) + F.col("id") * 300000 + 900000).alias("gps_stop"), F.lit("m").alias("monitorName"))
    rows = events(spark, d).select("event_id", (F.col("event_id") % 5).alias("process_id"), F.col("t").alias("gps_start"), F.col("value").alias("gps_offset"))
    return cut(rows, p, R0, R1, channel="good", monitor="m").select("event_id", "gpstime")
