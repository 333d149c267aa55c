"""Connected components of an edge table, in shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of edges (u, v), which are longs.

    Alternates large-star and small-star steps until every node points at its
    root: some log(nodes) rounds, and it ends for any input, as roots only ever get
    smaller. A hub is a group of a partial aggregate and the skewed side of a join,
    which the adaptive planner splits. Each round is written, so an executor
    that is lost costs its tasks only.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        before, e = e, written(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct(), "components")
        forget(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
