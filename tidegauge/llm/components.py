"""Connected components by alternating large-star and small-star contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id is either a centre or has one edge to a centre, so that the edges (a larger, b smaller) name the components."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    of = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return of.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable over undirected ``edges`` (a, b), for each id that has an edge.

    Each round moves edges towards the smallest neighbour: only minima are
    aggregated, so a hub costs its edges once and is never gathered. Rounds are
    written tables; their number is logarithmic in the longest chain in practice,
    and none where the edges are stars around their smallest ids already.
    Self loops and repeated edges are allowed; an empty input gives no rows.
    """
    cur = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    i = 0
    while not _are_stars(cur):
        both = cur.union(cur.select("b", "a"))
        low = _minimum(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = _minimum(large)
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        i += 1
        cur = scratch.write(small, f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
