"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .staging import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each vertex of an edge the smallest id that it reaches.

    Every round hangs neighbours under the least id seen, until no edge changes. A vertex with very
    many neighbours costs one partial minimum in each task. Loops and repeated edges are allowed.
    """
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi != lo")
    mark = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        under = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(under, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before = mark
        now, mark = _written(small.union(under.select("hi", F.col("m").alias("lo"))).distinct())
        if mark == before or not mark[0]:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, staged, with their number and the sum of their hashes, seen as they were written."""
    seen = Observation()
    marks = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")
    out = staged(edges.observe(seen, *marks), "components")
    return out, (seen.get["n"], seen.get["s"])
