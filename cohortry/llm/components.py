"""Connected components of an undirected edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.session import durable


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of `edges` that isn't the smallest of its component.

    Each round links every node's larger neighbours to its smallest one, then every node's smaller neighbours likewise; rounds
    needed grow with the logarithm of the longest path. Only minima are aggregated, a hub's join rows can be split by adaptive
    execution, and each round is cut by a checkpoint. Self links and nulls are ignored.
    """
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(
        F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))
    )
    now = durable(now.distinct())
    before = _sum(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(linked.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        after = _sum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
