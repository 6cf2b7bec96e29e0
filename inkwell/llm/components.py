"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, spent


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Each node's neighbours (larger ones, or smaller ones and itself) point to its smallest neighbour;
    with the written table of smallest neighbours, which is spent with the result.

    Smallest neighbours come from a partial aggregate and go back to the edges by a join, so no
    node's neighbours are gathered anywhere. They are written in between: the join then has an
    exchange of its own on both sides, and Spark can split the edges of a hub.
    """
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialize(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")))
    joined = both.join(low, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct(), low
    return joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct(), low


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (its smallest node) for every node with an edge; null ends and loops count for nothing.

    Repeated edges count once; without edges the result is empty. Tables of past rounds are deleted.
    """
    now = materialize(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)") + F.col("u") * 3)).first()
        if (n, total) == before:
            break
        before = (n, total)
        large, low = _star(now, True)
        small, lower = _star(large, False)
        past, now = now, materialize(small)
        spent(past, low, lower)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
