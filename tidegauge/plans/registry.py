"""The registry of queries, and the model's views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, and its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``t`` in Unix seconds."""
    return table(spark, sf_dir, "events").withColumn("t", seconds(F.col("ts")))


#: 2024-01-01, where the events begin, in Unix seconds; and the number of days they cover.
T0, DAYS = 1704067200, 30
SQL_EVENTS = "(SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"


def r6(c: Column) -> Column:
    """Rounded for comparison; zero has no sign."""
    return F.round(c, 6) + F.lit(0.0)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, start, end): [t, t + 40 * value) by event type, from the events."""
    e = events(spark, sf_dir)
    return e.select(F.col("event_type").alias("flag"), F.col("t").alias("start"), (F.col("t") + 40 * F.col("value")).alias("end"))


SQL_SEGMENTS = f"(SELECT event_type AS flag, t AS s, t + 40 * value AS e FROM {SQL_EVENTS})"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, samples): 64 samples a row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("channel"), F.col("embedding").cast("array<double>").alias("samples"), "label")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, idx, x, value) of the samples."""
    from tidegauge.operators.series import from_arrays

    return from_arrays(samples(spark, sf_dir), "samples")


SQL_SERIES = "(SELECT vec_id AS channel, (i - 1)::BIGINT AS idx, (i - 1)::DOUBLE AS x, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) r(i))"
