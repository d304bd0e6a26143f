"""Exact medians and most frequent values, without collecting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.operators.skew import running_totals
from cartwright.sources.staging import stage


def exact_medians(df: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Exact median of ``value`` per group, NULLs ignored.

    Equal values are counted first; the running counts then tell which value
    holds the middle position (or the two middle ones).
    """
    known = df.where(F.col(value).isNotNull() & F.col(by).isNotNull())
    counted = stage(
        known.groupBy(by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n")),
        "values",
    )
    totals = running_totals(counted, "value", ["n"], by=(by,), stored=True)
    # One row per group, groups being classes or feature names.
    sizes = counted.groupBy(by).agg(F.sum("n").alias("size"))

    def holds(position):
        return (F.col("cum_n") - F.col("n") < position) & (position <= F.col("cum_n"))

    lower = F.expr("(size + 1) div 2")
    upper = F.expr("size div 2 + 1")
    return (
        totals.join(F.broadcast(sizes), by)
        .where(holds(lower) | holds(upper))
        .groupBy(by)
        .agg(((F.min("value") + F.max("value")) / 2).alias("median"))
    )


def most_frequent(df: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Most frequent value per group, the smallest on ties; NULLs ignored."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode")
    )
