"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.shared import drop_table, write_table


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node of its component) for every node of the edges.

    Alternating large and small stars: each step hangs nodes on smaller neighbours, until every node hangs on the
    smallest of its component. The number of rounds grows with the logarithm of the longest path, the number of
    edges never grows, and no neighbourhood is gathered: minima are partial aggregates. Self-loops and
    repeated edges are allowed, edges with a null end are left out. No edges give no rows.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = write_table(ends, "component-edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u or v = u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = large.join(lowest, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).distinct()
        after = write_table(small, "component-edges")
        same = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = after
        if same:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
