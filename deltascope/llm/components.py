"""Connected components of an edge table, by alternating large-star and small-star
steps over Spark joins; no group of edges is ever gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node with an edge, the smallest node it reaches.

    Large-star: each node links its larger neighbours to its smallest one (itself
    included). Small-star: each node links its smaller neighbours and itself to the
    smallest. Both are an aggregation and an equi-join, whose hot keys AQE splits; when a
    round changes nothing, every node hangs directly under its root. Self-loops and
    nulls are ignored; an empty table gives no rows.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    e = e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    e = cut(e, "edges")
    before = None
    while True:
        # large-star
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: b < a in every row
        least = _least(e)
        linked = e.join(least, "a")
        e = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = cut(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
