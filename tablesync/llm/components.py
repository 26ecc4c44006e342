"""Connected components by alternating stars, as joins and map-side combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.work import stored


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node of its component, for every node with an edge.

    ``edges`` has long columns ``a`` and ``b``. Each round points neighbours at the smallest
    one known; edges never grow in number, and a hub's rows are only ever joined to one row.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        now = _small_star(_large_star(now))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def _pointed(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(stored(least, "least"), "a")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = _pointed(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stored(moved.distinct(), "edges")


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = _pointed(edges, least)
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stored(moved.union(joined.select("a", F.col("m").alias("b"))).distinct(), "edges")
