"""Joins and running totals that stay balanced when one key holds much of the data."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.sources.staging import stage


def hot_keys(
    facts: DataFrame, key: str, rows_per_part: int = 2_000_000, max_keys: int = 50_000
) -> DataFrame:
    """Keys with more than ``rows_per_part`` rows and the number of parts each needs.

    The bar also rises to 1/``max_keys`` of all rows, so fewer than ``max_keys``
    keys can pass it: the result has a proven bound and may be broadcast.
    """
    counts = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    share = F.floor(F.sum("n") / max_keys)
    bar = counts.agg(F.greatest(F.lit(rows_per_part), share)).scalar()
    hot = counts.where(F.col("n") > bar)
    return hot.select(key, F.ceil(F.col("n") / bar).cast("int").alias("parts"))


def spread_join(
    facts: DataFrame,
    dims: DataFrame,
    key: str,
    spread_on: tuple[str, ...],
    rows_per_part: int = 2_000_000,
) -> DataFrame:
    """Inner join of ``facts`` to ``dims`` (one row per key) with hot keys split.

    Rows of a hot key are dealt to several parts by a hash of ``spread_on`` and
    the one dimension row is copied to each part; other keys stay as they are. The
    small table of hot keys is found once and stored, both sides read it.
    """
    found = stage(hot_keys(facts.select(key), key, rows_per_part), "hot-keys")
    hot = F.broadcast(found)
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = facts.join(hot, key, "left").withColumn(
        "part", F.pmod(F.xxhash64(*spread_on), parts).cast("int")
    )
    copied = dims.join(hot, key, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    return dealt.drop("parts").join(copied.drop("parts"), [key, "part"]).drop("part")


def value_ranges(df: DataFrame, column: str, ranges: int) -> DataFrame:
    """Adds ``value_range``: the quantile range of ``column`` each row falls in."""
    steps = [i / ranges for i in range(1, ranges)]
    found = df.approxQuantile(column, steps, 1 / (4 * ranges))
    cuts = sorted(set(found))
    if not cuts:
        return df.withColumn("value_range", F.lit(0.0))
    splits = [-math.inf, *cuts, math.inf]
    return Bucketizer(splits=splits, inputCol=column, outputCol="value_range").transform(df)


def default_ranges(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions, within limits."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(partitions, 8), 2000)


def numbered(
    df: DataFrame, by: str, order: str, name: str, ranges: int | None = None
) -> DataFrame:
    """Adds ``name``: the place, from 0, of each row among those of ``by`` by ``order``.

    Rows are distinct in ``by`` and ``order``, of any type that sorts. Spark samples them
    for cut points and deals them to ranges, which may lie inside one group; rows are ranked
    in their range and the sizes of the group's earlier ranges are added. So no task orders
    a whole group. The cut points only place the work, the numbers are exact.
    """
    dealt = df.repartitionByRange(ranges or default_ranges(df), by, order)
    cut = stage(dealt.withColumn("value_range", F.spark_partition_id()), "numbered")
    inside = W.partitionBy(by, "value_range").orderBy(order)
    earlier = (
        W.partitionBy(by).orderBy("value_range").rowsBetween(W.unboundedPreceding, -1)
    )
    sizes = cut.groupBy(by, "value_range").agg(F.count("*").alias("n"))
    before = sizes.select(
        by, "value_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    return (
        cut.withColumn("place", F.row_number().over(inside) - 1)
        .join(before, [by, "value_range"])
        .select(*df.columns, (F.col("before") + F.col("place")).alias(name))
    )


def running_totals(
    df: DataFrame,
    order: str,
    sums: list[str],
    by: tuple[str, ...] = (),
    descending: bool = False,
    ranges: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Adds ``cum_<column>``: sums over this and all earlier ``order`` values.

    ``order`` is distinct inside each group. Rows are cut into value ranges at
    approximate quantiles; each range is summed on its own and the totals of the
    ranges before it are added. The quantiles only balance the work, the sums
    are exact. The input is stored once, because it is read three times, unless
    the caller has done so (``stored``). There are as many ranges as the session
    has shuffle partitions, within limits.
    """
    ranges = ranges or default_ranges(df)
    cut = value_ranges(df if stored else stage(df, "totals"), order, ranges)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = (
        W.partitionBy(*by, "value_range")
        .orderBy(direction)
        .rowsBetween(W.unboundedPreceding, 0)
    )
    range_order = F.col("value_range").desc() if descending else F.col("value_range").asc()
    earlier = (
        W.partitionBy(*(by or [F.lit(0)]))
        .orderBy(range_order)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = (
        cut.groupBy(*by, "value_range")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select(
            *by,
            "value_range",
            *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in sums],
        )
    )
    return (
        cut.select("*", *[F.sum(c).over(inside).alias(f"in_{c}") for c in sums])
        .join(offsets, [*by, "value_range"])
        .select(
            *df.columns,
            *[(F.col(f"in_{c}") + F.col(f"before_{c}")).alias(f"cum_{c}") for c in sums],
        )
    )
