"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps.

Every step moves links towards the least node of a neighbourhood; only the least per node is aggregated, so a hub costs
a partial aggregation and a join that adaptive execution may split. Each round ends in a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), both long; root is the component's least node."""

    def directed(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(20, 0)))")).first())

    e = stored(directed(links), "links")
    before, now = None, state(e)
    while now != before:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = stored(directed(large.join(small, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))), "links")
        before, now = now, state(e)
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
