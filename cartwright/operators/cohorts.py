"""Weekly acquisition cohorts and their retention.

Events are read once: they shrink to user-days, then to one row per user and
active week, then to a table of cohort times week from which all reports follow.
A user holds at most one row per calendar day, so no user is too large a group.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.functions.columns import exact_sum, is_step, monday, pct


def user_day_activity(shaped: DataFrame) -> DataFrame:
    """One row per user and day with a first visit or a session start."""
    kept = shaped.where(
        F.col("event_name").isin("first_visit", "session_start")
        & F.col("user_pseudo_id").isNotNull()
    )
    return kept.groupBy("user_pseudo_id", F.col("event_day").alias("activity_date")).agg(
        F.max(F.when(is_step("first_visit"), 1).otherwise(0)).alias("had_first_visit"),
        F.max(F.when(is_step("session_start"), 1).otherwise(0)).alias("had_session"),
    )


def first_visit_date(activity: DataFrame) -> DataFrame:
    """Earliest first-visit day per user; NULL if none was seen."""
    return activity.groupBy("user_pseudo_id").agg(
        F.min(F.when(F.col("had_first_visit") == 1, F.col("activity_date"))).alias(
            "first_visit_date"
        )
    )


def cohort_week(visits: DataFrame, drop_through: date | None = None) -> DataFrame:
    """Monday week of the first visit; cohorts up to ``drop_through`` are left out."""
    cohorts = visits.where(F.col("first_visit_date").isNotNull()).withColumn(
        "cohort_week", monday("first_visit_date")
    )
    if drop_through is not None:
        cohorts = cohorts.where(F.col("cohort_week") > F.lit(drop_through))
    return cohorts


def cohort_sizes(cohorts: DataFrame) -> DataFrame:
    """Users per cohort; ``cohorts`` has one row per user."""
    return cohorts.groupBy("cohort_week").agg(F.count("*").alias("cohort_size"))


def user_weeks(activity: DataFrame, floor: str = "visit") -> DataFrame:
    """One row per user and week since acquisition.

    ``active`` tells whether the user had a session in that week on or after the
    floor (the first visit, or the Monday of its week); ``joined`` is 1 on the
    acquisition week. Users without a first visit keep NULL cohorts, so that the
    last activity day still covers them.
    """
    by_user = W.partitionBy("user_pseudo_id")
    visit = F.min(F.when(F.col("had_first_visit") == 1, F.col("activity_date"))).over(by_user)
    days = activity.withColumn("first_visit_date", visit).withColumn(
        "cohort_week", monday("first_visit_date")
    )
    start = {"visit": "first_visit_date", "cohort": "cohort_week"}[floor]
    active = (F.col("had_session") == 1) & (F.col("activity_date") >= F.col(start))
    joined = F.col("activity_date") == F.col("first_visit_date")
    week = F.datediff(monday("activity_date"), F.col("cohort_week")) / 7
    return days.groupBy(
        "user_pseudo_id", "cohort_week", week.cast("int").alias("weeks_since_acquisition")
    ).agg(
        F.max(F.when(active, 1).otherwise(0)).alias("active"),
        F.max(F.when(joined, 1).otherwise(0)).alias("joined"),
        F.max("activity_date").alias("last_activity_date"),
    )


def weeks_since(weeks: DataFrame) -> DataFrame:
    """Distinct active weeks of each acquired user."""
    return weeks.where((F.col("active") == 1) & F.col("cohort_week").isNotNull()).select(
        "user_pseudo_id", "cohort_week", "weeks_since_acquisition"
    )


def retained_users(active_weeks: DataFrame, weeks: tuple[int, ...]) -> DataFrame:
    """Active users per cohort and week; the input has one row per user and week."""
    return (
        active_weeks.where(F.col("weeks_since_acquisition").isin(*weeks))
        .groupBy("cohort_week", "weeks_since_acquisition")
        .agg(F.count("*").alias("retained_users"))
    )


def dataset_end(activity: DataFrame) -> DataFrame:
    """Last activity day of all users, one row."""
    return activity.agg(F.max("activity_date").alias("max_activity_date"))


def cohort_table(weeks: DataFrame, drop_through: date | None = None) -> DataFrame:
    """One row per cohort: size, last activity day, and retained users by week.

    The window over all rows only sees cohort times week totals.
    """
    totals = weeks.groupBy("cohort_week", "weeks_since_acquisition").agg(
        F.sum("active").alias("retained"),
        F.sum("joined").alias("joined"),
        F.max("last_activity_date").alias("last_activity_date"),
    )
    ended = totals.withColumn(
        "max_activity_date", F.max("last_activity_date").over(W.partitionBy(F.lit(0)))
    ).where(F.col("cohort_week").isNotNull())
    if drop_through is not None:
        ended = ended.where(F.col("cohort_week") > F.lit(drop_through))
    seen = F.when(F.col("retained") > 0, F.struct("weeks_since_acquisition", "retained"))
    return ended.groupBy("cohort_week").agg(
        F.sum("joined").alias("cohort_size"),
        F.max("max_activity_date").alias("max_activity_date"),
        F.map_from_entries(F.collect_list(seen)).alias("retained_by_week"),
    )


def cohort_grid(cohorts: DataFrame, max_week: int = 8) -> DataFrame:
    """Each cohort times week 0 to ``max_week``, with the week's first day."""
    grid = cohorts.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_week))).alias("week_number"))
    return grid.withColumn(
        "retention_week_start",
        F.date_add("cohort_week", (F.col("week_number") * 7).cast("int")),
    )


def observable_mask(grid: DataFrame) -> DataFrame:
    """Retention rate; NULL for weeks after the last activity day, 0 without activity."""
    retained = F.coalesce(
        F.try_element_at("retained_by_week", F.col("week_number")), F.lit(0)
    )
    future = F.col("retention_week_start") > F.col("max_activity_date")
    return grid.withColumn(
        "retention_rate_pct", F.when(~future, pct(retained, F.col("cohort_size")))
    )


def cohort_rates(cohorts: DataFrame, weeks: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Month label and unrounded retention at some weeks; NULL without activity."""
    return cohorts.withColumns(
        {
            "cohort_month": F.date_format("cohort_week", "yyyy-MM"),
            **{
                f"week_{w}_rate": F.try_divide(
                    F.try_element_at("retained_by_week", F.lit(w)), F.col("cohort_size")
                )
                for w in weeks
            },
        }
    )


def week_eligibility(cohorts: DataFrame, weeks: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Whether week ``w`` of the cohort had begun by the last activity day."""
    return cohorts.withColumns(
        {
            f"eligible_week_{w}": F.date_add("cohort_week", 7 * w) <= F.col("max_activity_date")
            for w in weeks
        }
    )


def weighted_rate(week: int):
    """Size-weighted retention over eligible cohorts; a missing rate counts as 0."""
    eligible = F.col(f"eligible_week_{week}")
    kept = F.col("cohort_size") * F.coalesce(F.col(f"week_{week}_rate"), F.lit(0.0))
    return pct(
        exact_sum(F.when(eligible, kept).otherwise(0.0), 12),
        F.sum(F.when(eligible, F.col("cohort_size")).otherwise(0)),
    )
