"""Shares of totals and the mix-versus-behaviour split, on already aggregated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.functions.columns import exact_sum, pct
from cartwright.sources.staging import stage


def share_of_total(value: str, by: list[str], digits: int = 2) -> Column:
    """Percentage of the group total.

    A window, not a join to a totals table: the join would read the events a
    second time. Use it on report rows only, of which a group holds few.
    """
    return pct(F.col(value), F.sum(value).over(W.partitionBy(*by)), digits)


def with_share(df: DataFrame, value: str, by: str, name: str, digits: int = 2) -> DataFrame:
    """Adds ``name``: the percentage of the group total, for groups of any number of rows.

    The rows are stored, so that the report behind them runs once. Each task adds up its own
    part of a group, and the one row of totals a group is joined back; nulls are a group too.
    """
    rows = stage(df, "shares")
    totals = rows.groupBy(F.col(by).alias("of_group")).agg(F.sum(value).alias("group_total"))
    joined = rows.join(totals, F.col(by).eqNullSafe(F.col("of_group")))
    return joined.select(*df.columns, pct(F.col(value), F.col("group_total"), digits).alias(name))


def share_of_grand_total(value: str, digits: int = 2) -> Column:
    """Percentage of the total over all report rows."""
    return pct(F.col(value), F.sum(value).over(W.partitionBy(F.lit(0))), digits)


def stack_scopes(df: DataFrame, known: Column, everything: str, known_only: str) -> DataFrame:
    """Each row once under ``everything`` and, where ``known``, again under ``known_only``."""
    scopes = F.array_compact(F.array(F.lit(everything), F.when(known, F.lit(known_only))))
    return df.select(F.explode(scopes).alias("scope"), "*")


def mix_rate_decomposition(
    df: DataFrame,
    periods: tuple[str, str],
    segment: str,
    weight: str,
    rate: str,
    names: dict[str, tuple[int, int]],
    by: tuple[str, ...] = (),
    digits: int = 3,
) -> DataFrame:
    """Sum over segments of share times rate, for pairs of periods.

    ``names`` gives each output column the periods (0 or 1) its shares and its
    rates come from. Segments missing in one of the two periods drop out.
    """
    total = F.sum(weight).over(W.partitionBy(*by, "period"))
    shares = df.withColumn("share", F.try_divide(F.col(weight), total))

    def of(period: int, column: str) -> Column:
        return F.max(F.when(F.col("period") == periods[period], F.col(column)))

    paired = (
        shares.where(F.col("period").isin(*periods))
        .groupBy(*by, segment)
        .agg(
            F.count_distinct("period").alias("periods_seen"),
            *[of(i, "share").alias(f"share_{i}") for i in (0, 1)],
            *[of(i, rate).alias(f"rate_{i}") for i in (0, 1)],
        )
        .where(F.col("periods_seen") == 2)
    )
    sums = [
        F.round(100 * exact_sum(F.col(f"share_{s}") * F.col(f"rate_{r}")), digits).alias(name)
        for name, (s, r) in names.items()
    ]
    return paired.groupBy(*by).agg(*sums)
