"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.sources.staging import stage


def _mark(links: DataFrame) -> tuple:
    """Number and order-free hash sum of the links, to see whether a round changed them."""
    row = links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every linked node but the roots; a root is its component's least node.

    Each round hangs every node's larger neighbours on its least neighbour, then every
    node on its least smaller one. Rounds grow with the logarithm of the component
    size, and every round is joins and minima over links: no node's neighbours meet in
    one task unless Spark can split them. Rounds are written to the shared folder.
    """
    high, low = F.greatest(left, right), F.least(left, right)
    now = links.where(F.col(left) != F.col(right)).select(high.alias("node"), low.alias("root"))
    now = stage(now.distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(
            now.select(F.col("root").alias("node"), F.col("node").alias("root"))
        )
        least = both.groupBy("node").agg(F.min("root").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        large = (
            both.where(F.col("root") > F.col("node"))
            .join(least, "node")
            .select(F.col("root").alias("node"), F.col("least").alias("root"))
            .distinct()
        )
        lowest = large.groupBy("node").agg(F.min("root").alias("least"))
        moved = large.join(lowest, "node").where(F.col("root") != F.col("least"))
        small = moved.select(F.col("root").alias("node"), F.col("least").alias("root"))
        following = stage(
            small.unionByName(lowest.withColumnRenamed("least", "root")).distinct(), "links"
        )
        after = _mark(following)
        if after == mark:
            return following
        now, mark = following, after
    return now
