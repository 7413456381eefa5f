import pytest
from pyspark.sql import functions as F

from tidegauge.operators import events as E
from tidegauge.operators import segments as S


def seg(spark, rows, flag="f"):
    return spark.createDataFrame([(flag, float(a), float(b)) for a, b in rows], "flag string, start double, end double")


def got(df):
    return sorted((r.start, r.end) for r in df.collect())


KNOWN, ACTIVE = [(0, 3), (6, 7)], [(1, 2), (3, 4), (5, 7)]


@pytest.fixture
def flag(spark):
    return S.as_flags(seg(spark, KNOWN), seg(spark, ACTIVE))


def test_cluster_golden(spark):
    rows = [(11.0, 0.0), (1.0, 1.9), (1.0, 1.95), (10.0, 2.0), (1.0, 2.05), (1.0, 2.1), (9.0, 4.0)]
    df = spark.createDataFrame(rows, "amplitude double, time double")
    for coarse in (None, 1.0, 0.07):
        once = E.cluster(df, "time", "amplitude", 0.6, coarse=coarse)
        assert sorted((r.amplitude, r.time) for r in once.collect()) == [(9.0, 4.0), (10.0, 2.0), (11.0, 0.0)]
        assert E.cluster(once, "time", "amplitude", 0.6, coarse=coarse).count() == 3
        assert [(r.amplitude, r.time) for r in E.cluster(df, "time", "amplitude", 10, coarse=coarse).collect()] == [(11.0, 0.0)]
    assert E.cluster(df.limit(0), "time", "amplitude", 1, coarse=1.0).count() == 0
    with pytest.raises(ValueError):
        E.cluster(df, "time", "amplitude", 0)


def test_event_rate_edges(spark):
    df = spark.createDataFrame([(float(t),) for t in (0, 1, 9.5, 10, 10.5, -1)], "time double")
    out = E.event_rate(df, 5, start=0, end=10).orderBy("bin").collect()
    assert [(r.time, r.rate) for r in out] == [(0.0, 0.4), (5.0, 0.4)]
    assert E.event_rate(df.limit(1), 5).count() == 0
    assert E.event_rate(df.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        E.time_column(spark.createDataFrame([(1.0, 2.0)], "time double, gps double"))


def test_value_bins():
    assert [n for _, n in E.value_bins("snr", [10, 100])] == ["snr >= 10", "snr >= 100"]
    assert [n for _, n in E.value_bins("snr", [1, 2, 3], "in")] == ["snr in (1, 2)", "snr in (2, 3)"]


def test_coalesce_golden(spark):
    assert got(S.coalesce(seg(spark, [(1, 2), (3, 4), (4, 5), (7, 7)]))) == [(1.0, 2.0), (3.0, 5.0)]
    for coarse in (0.5, 2.0, 100.0):
        assert got(S.coalesce(seg(spark, [(0, 9), (1, 2), (9, 10), (12, 13)]), coarse=coarse)) == [(0.0, 10.0), (12.0, 13.0)]
    assert S.coalesce(seg(spark, []).limit(0)).count() == 0


def test_flag_golden(flag, spark):
    act = lambda f: got(S.kind(f, "active"))
    assert act(S.flag_coalesce(flag)) == [(1.0, 2.0), (6.0, 7.0)]
    assert [tuple(round(x, 6) for x in r) for r in act(S.flag_contract(flag, 0.1))] == [(1.1, 1.9), (3.1, 3.9), (5.1, 6.9)]
    assert [tuple(round(x, 6) for x in r) for r in act(S.flag_protract(flag, 0.1))] == [(0.9, 2.1), (2.9, 4.1), (4.9, 7.1)]
    padded = S.flag_pad(flag, -0.5, 1)
    assert got(S.kind(padded, "known")) == [(-0.5, 4.0), (5.5, 8.0)] and act(padded) == [(0.5, 3.0), (2.5, 5.0), (4.5, 8.0)]
    assert act(S.flag_coalesce(padded)) == [(0.5, 4.0), (5.5, 8.0)]
    assert act(S.flag_invert(flag)) == [(0.0, 1.0), (2.0, 3.0)]
    assert S.flag_regular(flag).first().regular is False and S.flag_regular(S.flag_coalesce(flag)).first().regular is True
    assert act(S.flag_contract(flag, 5)) == []


def test_algebra_identities(spark):
    a, b = seg(spark, [(0, 5), (7, 9), (8, 12)]), seg(spark, [(3, 8), (11, 20)])
    assert got(S.intersection(a, b)) == [(3.0, 5.0), (7.0, 8.0), (11.0, 12.0)]
    assert got(S.difference(a, b)) == [(0.0, 3.0), (8.0, 11.0)]
    assert got(S.symmetric_difference(a, b)) == got(S.union(S.difference(a, b), S.difference(b, a)))
    assert got(S.union(a, b)) == [(0.0, 20.0)]
    assert got(S.difference(a, a)) == []


def test_membership(spark):
    df = spark.createDataFrame([(float(t),) for t in (0, 1, 1.99, 2, 3, 4.5)], "time double")
    s = seg(spark, [(1, 2), (4, 100)])
    for width in (0.5, 10.0):
        assert [r.time for r in S.in_segments(df, s, "time", width=width).orderBy("time").collect()] == [1.0, 1.99, 4.5]
        assert S.not_in_segments(df, s, "time", width=width).count() == 3
    assert S.not_in_segments(df, s.limit(0), "time", width=1.0).count() == 6
    plan = S.in_segments(df, s, "time", width=1.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_segment_tables_round_trip(spark, flag):
    named = flag.withColumn("flag", F.lit("X1:A:1"))
    tables = S.to_segment_tables(named)
    assert sorted(map(tuple, S.from_segment_tables(*tables).collect())) == sorted(map(tuple, named.collect()))


def test_veto_definers(spark):
    d = spark.createDataFrame([("X1", "A", 1, 0, 0), ("X1", "A", 1, 50, 60), ("X1", "B", 1, 500, 600), ("Y1", "C", 1, 0, 10)], "ifo string, name string, version int, start_time int, end_time int")
    assert [(r.flag, r.start, r.end) for r in S.from_veto_definers(d, 10, 100, "X1").collect()] == [("X1:A:1", 10.0, 100.0)]


def test_stretches_change_nothing(spark):
    import random

    r = random.Random(4)
    rows = lambda n: spark.createDataFrame([(r.choice("ab"), x := r.uniform(-50, 100), x + r.expovariate(0.2)) for _ in range(n)], "flag string, start double, end double")
    a, b = rows(80), rows(60)
    full = lambda df: sorted((x.flag, x.start, x.end) for x in df.collect())
    for op in (S.union, S.intersection, S.difference, S.symmetric_difference):
        want = full(op(a, b, ["flag"]))
        assert want and all(full(op(a, b, ["flag"], coarse=c)) == want for c in (7.0, 33.3, 1000.0))
    keyed = E.cluster(a, "start", "end", 1.5, by=["flag"])
    assert full(E.cluster(a, "start", "end", 1.5, by=["flag"], coarse=6.0)) == full(keyed) and keyed.count() < 80


def test_overlaps_of_copies(spark):
    """Equal segments meet once, and all pairs of their copies come out."""
    from tidegauge.operators import segments as S

    a = spark.createDataFrame([("k", 0.0, 25.0)] * 40 + [("k", 3.0, 4.0), ("j", 0.0, 9.0), ("k", 5.0, 5.0), (None, 0.0, 9.0)], "key string, start double, end double")
    b = spark.createDataFrame([("k", 2.0, 30.0)] * 50 + [("k", 25.0, 26.0), ("j", 9.0, 10.0), ("j", 8.0, 9.0), ("j", 8.0, 9.0)], "key string, start double, end double")
    joined = S.overlap_join(a, b, width=10.0, keys=["key"])
    got = {tuple(r)[:-1]: r["count"] for r in joined.groupBy(*joined.columns).count().collect()}
    assert got == {("k", 0.0, 25.0, 2.0, 30.0): 2000, ("k", 3.0, 4.0, 2.0, 30.0): 50, ("j", 0.0, 9.0, 8.0, 9.0): 2}
    assert S.overlap_join(a.drop("key"), b.drop("key"), width=10.0).count() == 40 * 50 + 3 * 50 + 40 + 42 * 2
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence(1, __a") < plan.index("Join Inner") < plan.index("Aggregate [key")


def test_overlaps_of_distinct_segments(spark):
    """Where few segments are equal, they are not counted, so that each side is shuffled once; copies on one side alone are."""
    from tidegauge.operators import segments as S

    segments = lambda rows: spark.createDataFrame(rows, "key string, start double, end double")
    full = lambda df: sorted(map(tuple, df.collect()))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    one = [("k", float(i), i + 7.5) for i in range(60)] + [("k", 3.0, 10.5), ("j", 0.0, 9.0), ("k", 5.0, 5.0)]
    few, many = [("k", i + 0.25, i + 12.0) for i in range(50)] + [("j", 9.0, 10.0)] * 2, [("k", 2.0, 30.0)] * 5 + [("j", 8.0, 9.0)] * 4
    for other in (few, many):
        want = sorted((k, s, e, t, f) for k, s, e in one for m, t, f in other if k == m and s < f and t < e and s < e and t < f)
        for x, y, pairs in ((one, other, want), (other, one, sorted((k, t, f, s, e) for k, s, e, t, f in want))):
            joined = S.overlap_join(segments(x), segments(y), width=10.0, keys=["key"])
            assert full(joined) == pairs and plan(joined).count("Aggregate [key") == (other is many)
    assert S.overlap_join(segments(one), segments(one).limit(0), width=10.0, keys=["key"]).count() == 0
