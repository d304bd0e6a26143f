"""Weekly retention reports, all from one cohort table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.config import CommerceConfig
from cartwright.functions.columns import pct
from cartwright.operators.cohorts import (
    cohort_grid,
    cohort_rates,
    cohort_table,
    observable_mask,
    user_day_activity,
    user_weeks,
    week_eligibility,
    weighted_rate,
)
from cartwright.operators.shape import shape_events


def cohorts_of(events: DataFrame, floor: str, drop_through=None) -> DataFrame:
    return cohort_table(user_weeks(user_day_activity(shape_events(events)), floor), drop_through)


def retention_long(events: DataFrame, config: CommerceConfig) -> DataFrame:
    weeks = cohorts_of(events, "visit").select(
        "cohort_week",
        "cohort_size",
        F.explode("retained_by_week").alias("weeks_since_acquisition", "retained_users"),
    )
    return (
        weeks.where(F.col("weeks_since_acquisition") <= config.max_retention_week)
        .select("*", pct("retained_users", "cohort_size").alias("retention_rate_pct"))
        .orderBy("cohort_week", "weeks_since_acquisition")
    )


def retention_matrix(events: DataFrame, config: CommerceConfig) -> DataFrame:
    cohorts = cohorts_of(events, "cohort", config.partial_cohort_until)
    rates = observable_mask(cohort_grid(cohorts, config.max_retention_week))
    weeks = list(range(config.max_retention_week + 1))
    matrix = (
        rates.groupBy("cohort_week", "cohort_size")
        .pivot("week_number", weeks)
        .agg(F.max("retention_rate_pct"))
    )
    return matrix.select(
        "cohort_week", "cohort_size", *[F.col(f"`{w}`").alias(f"week_{w}") for w in weeks]
    ).orderBy("cohort_week")


def retention_monthly_weighted(events: DataFrame, config: CommerceConfig) -> DataFrame:
    weeks = config.summary_weeks
    cohorts = cohorts_of(events, "visit", config.partial_cohort_until)
    rated = week_eligibility(cohort_rates(cohorts, weeks), weeks)
    return (
        rated.groupBy("cohort_month")
        .agg(
            F.sum("cohort_size").alias("acquired_users"),
            F.count_if(f"eligible_week_{weeks[0]}").alias(
                f"cohorts_observed_for_week_{weeks[0]}"
            ),
            *[weighted_rate(w).alias(f"weighted_week_{w}_retention_pct") for w in weeks],
        )
        .orderBy("cohort_month")
    )


REPORTS = {
    f.__name__: f for f in (retention_long, retention_matrix, retention_monthly_weighted)
}
