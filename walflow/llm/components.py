"""Connected components by alternating large-star and small-star steps on an edge table; nothing but two numbers a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walflow.llm.common import dropped, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Each node links its larger (or no larger) neighbours to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.filter("v > u") if large else both
    # a hub's edges meet its one row of `least` here: a plain join, which adaptive execution splits when one node holds many edges
    linked = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return linked.unionByName(own).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) of longs in any order -> (node, root): the smallest node that each linked node reaches. Nodes without links are absent."""
    edges = saved(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = None
    while True:
        new = saved(_star(_star(edges, True), False), "cc")
        now = new.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        dropped(edges)
        edges = new
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return saved(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
