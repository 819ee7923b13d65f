"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """id, root: for every node of ``edges`` (a, b: long) the least node that it
    can reach. Every round is written to the shared folder, so neither the plan
    nor a lost executor's work grows; the rounds are logarithmic in the longest
    path. Minima are taken map-side first, so a node of many links is no hot group.
    """
    edges = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, durable(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(before)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("id"), "root").distinct())
