"""Exploration of the customer feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.functions.columns import money_mean, pct
from cartwright.ml.stats import exact_medians
from cartwright.operators.shares import share_of_grand_total
from cartwright.sources.schema import FEATURES, NUMERIC_FEATURES

DAYS = "days_first_visit_to_purchase"
REVENUE = "first_order_revenue"


def target_distribution(features: DataFrame, label: str) -> DataFrame:
    counts = features.groupBy(label).agg(F.count("*").alias("count"))
    return counts.select("*", share_of_grand_total("count").alias("percent")).orderBy(label)


def missing_summary(features: DataFrame) -> DataFrame:
    """Columns that hold NULLs, with their count and percentage; one pass."""
    counts = features.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in features.columns],
    )
    long = counts.unpivot("rows", features.columns, "column_name", "missing_count")
    return long.where(F.col("missing_count") > 0).select(
        "column_name", "missing_count", pct("missing_count", "rows").alias("missing_percent")
    )


def means_by_target(features: DataFrame, label: str) -> DataFrame:
    measured = {c: F.avg(c) for c in NUMERIC_FEATURES if c != DAYS}
    measured[REVENUE] = money_mean(REVENUE)
    means = [F.round(mean, 2).alias(c) for c, mean in measured.items()]
    return features.groupBy(label).agg(*means).orderBy(label)


def missing_by_target(features: DataFrame, label: str, column: str = DAYS) -> DataFrame:
    """Percent of each class with and without a value."""
    counts = features.groupBy(label).agg(F.count("*").alias("n"), F.count(column).alias("known"))
    return counts.select(
        label,
        (100 * F.try_divide("known", "n")).alias("present_pct"),
        (100 * F.try_divide(F.col("n") - F.col("known"), "n")).alias("missing_pct"),
    ).orderBy(label)


def days_stats_by_target(features: DataFrame, label: str, column: str = DAYS) -> DataFrame:
    stats = features.groupBy(label).agg(
        F.count(column).alias("count"), F.round(F.avg(column), 2).alias("mean")
    )
    medians = exact_medians(features.select(label, F.col(column).alias("value")), label)
    return (
        stats.join(medians, label, "left")
        .select(label, "count", "mean", F.round("median", 2).alias("median"))
        .orderBy(label)
    )


def repeat_rate_by(features: DataFrame, label: str, columns: tuple[str, ...]) -> DataFrame:
    """Customers and repeat rate per value; rows with a missing value are left out."""
    known = features.dropna(subset=list(columns))
    counts = known.groupBy(*columns).agg(
        F.count("user_pseudo_id").alias("customers"),
        F.sum(label).alias("repeat_buyers"),
        F.round(F.avg(label) * 100, 2).alias("repeat_purchase_rate"),
    )
    return counts.orderBy(F.desc("repeat_purchase_rate"), F.desc("customers"), *columns)


def device_summary(features: DataFrame, label: str) -> DataFrame:
    return repeat_rate_by(features, label, ("device_category",))


def source_summary(features: DataFrame, label: str) -> DataFrame:
    return repeat_rate_by(features, label, ("first_source", "first_medium"))


def model_columns(features: DataFrame, label: str) -> DataFrame:
    """The 13 features and the label."""
    return features.select(*FEATURES, label)
