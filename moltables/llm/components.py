"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltables.session import forget, stable


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or not larger (small star) neighbours to the least node around it.

    The least neighbour comes from an aggregate that sums up before the
    shuffle, and the way back is a join, so a hub is split like any hot key.
    """
    both = e.union(e.select("v", "u"))  # e has u > v
    at = both if large else e
    least = stable(at.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    d = at.join(least, "u")
    if large:
        out = d.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = d.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge to another; the component is its least node.

    Null ends and loops count as no edge. The number of rounds grows with the
    logarithm of the number of nodes; each round is a table in the shared
    folder, so losing an executor costs one round.
    """
    e = (edges.filter(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = stable(e)
    mark = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
    seen = e.select(mark.alias("m")).first()["m"]
    while seen[0]:
        last, e = e, stable(_star(_star(e, large=True), large=False))
        forget(last)
        now = e.select(mark.alias("m")).first()["m"]
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
