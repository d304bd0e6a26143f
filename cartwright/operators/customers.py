"""What is known about a customer at the first order, and what follows it."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.functions.columns import event_time, is_step
from cartwright.operators.skew import spread_join


def first_orders(orders: DataFrame) -> DataFrame:
    """First order of each customer, and the next distinct order time.

    Orders sharing a timestamp shrink to one row, led by the smallest order key;
    of these only the first two per customer are needed. Spark drops the others
    before the shuffle, so customers with very many orders stay cheap.
    """
    kept = [c for c in orders.columns if c not in ("user_pseudo_id", "order_timestamp")]
    lead = F.min_by(F.struct(*kept), F.struct("transaction_id", "ga_session_id"))
    by_time = orders.groupBy("user_pseudo_id", "order_timestamp").agg(lead.alias("lead"))
    by_user = W.partitionBy("user_pseudo_id").orderBy("order_timestamp")
    earliest_two = by_time.withColumn("n", F.row_number().over(by_user)).where(F.col("n") <= 2)
    customers = earliest_two.groupBy("user_pseudo_id").agg(
        F.min("order_timestamp").alias("first_order_timestamp"),
        F.max(F.when(F.col("n") == 2, F.col("order_timestamp"))).alias("next_order_timestamp"),
        F.min_by("lead", "n").alias("lead"),
    )
    return customers.select(
        "user_pseudo_id", "first_order_timestamp", "next_order_timestamp", "lead.*"
    )


def repeat_label(days: int) -> Column:
    """1 if another order follows the first one strictly and within ``days`` times 24 hours.

    The next distinct order time decides: if it is too late, so are all others.
    """
    limit = F.col("first_order_timestamp") + int(timedelta(days=days).total_seconds()) * 1_000_000
    return F.when(F.col("next_order_timestamp") <= limit, 1).otherwise(0)


def point_in_time_features(customers: DataFrame, shaped: DataFrame) -> DataFrame:
    """Counts over each customer's events up to and including the first order.

    Events after the last of these orders count for nobody: their days are not read.
    Only events of the given customers go into the spread join, and only their rows
    are counted to find the customers whose events must be split. The time condition
    is checked right in the join, and counts are combined on the map side before the
    next shuffle.
    """
    cutoffs = customers.select("user_pseudo_id", "first_order_timestamp")
    last = cutoffs.agg(F.max("first_order_timestamp")).first()[0]
    if last is None:
        last = -1
    # Days are named in the property's zone, at most a day away from the UTC day.
    last_day = (datetime.fromtimestamp(last / 1e6, UTC) + timedelta(days=1)).strftime("%Y%m%d")
    theirs = (
        shaped.where((F.col("event_timestamp") <= last) & (F.col("event_date") <= last_day))
        .select("user_pseudo_id", "event_id", "event_timestamp", "event_name", "ga_session_id")
        .join(cutoffs.select("user_pseudo_id"), "user_pseudo_id", "left_semi")
    )
    seen = spread_join(
        theirs, cutoffs, "user_pseudo_id", spread_on=("event_id", "event_timestamp")
    ).where(F.col("event_timestamp") <= F.col("first_order_timestamp"))

    def events(name: str) -> Column:
        return F.count_if(is_step(name))

    behaviour = seen.groupBy("user_pseudo_id").agg(
        F.count_distinct("ga_session_id").alias("sessions_before_first_purchase"),
        events("view_item").alias("product_views_before_purchase"),
        events("add_to_cart").alias("add_to_cart_before_purchase"),
        events("begin_checkout").alias("checkout_events_before_purchase"),
        events("view_search_results").alias("search_events_before_purchase"),
        F.min(F.when(is_step("first_visit"), F.col("event_timestamp"))).alias(
            "first_visit_timestamp"
        ),
    )
    counts = [c for c in behaviour.columns if c.endswith("_purchase")]
    return customers.join(behaviour, "user_pseudo_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in counts}
    )


def calendar_features() -> dict[str, Column]:
    """Day of week (Sunday is 1) and hour of the first order, UTC."""
    at = event_time("first_order_timestamp")
    return {
        "purchase_day_of_week": F.dayofweek(at),
        "purchase_hour_utc": F.hour(at),
    }


def days_since_first_visit() -> Column:
    """Whole 24-hour days from the first visit to the order; NULL without a visit."""
    day_micros = 86_400_000_000
    return F.expr(f"(first_order_timestamp - first_visit_timestamp) div {day_micros}")
