"""Streaming forms of event rates, clusters and rolling buffers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_rate_stream(events: DataFrame, *, time: str, stride: str, late: str, by: list[str] | None = None) -> DataFrame:
    """(by..., start, end, rate): events a second in fixed steps; rows later than ``late`` behind the newest are dropped."""
    w = F.window(time, stride)
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    out = events.withWatermark(time, late).groupBy(*(by or []), w.alias("window")).agg(F.count("*").alias("__n"))
    return out.select(*(by or []), F.col("window.start").alias("start"), F.col("window.end").alias("end"), (F.col("__n") / seconds).alias("rate"))


def cluster_stream(events: DataFrame, *, time: str, gap: str, rank: str, late: str, by: list[str]) -> DataFrame:
    """The row of largest rank of each session: rows of a key at most ``gap`` apart."""
    rest = [c for c in events.columns if c not in by]
    out = events.withWatermark(time, late).groupBy(*by, F.session_window(time, gap)).agg(F.max_by(F.struct(*rest), F.col(rank)).alias("best"), F.count("*").alias("n"))
    return out.select(*by, "best.*", "n")


def rolling_buffer(samples: DataFrame, *, size: int, keys: list[str]) -> DataFrame:
    """(keys..., idx, value) of the last ``size`` samples (idx, value) of each key, after every batch that has some."""
    kinds = dict(samples.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "idx long, value double"])

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held += list(zip(f["idx"], f["value"], strict=True))
        held = sorted(set(held))[-size:]
        state.update(([int(i) for i, _ in held], [float(v) for _, v in held]))
        yield pd.DataFrame([(*key, i, v) for i, v in held], columns=[*keys, "idx", "value"])

    return samples.groupBy(*keys).applyInPandasWithState(update, schema, "idx array<long>, value array<double>", "update", "NoTimeout")
