"""Repeat purchase: lifecycle segments, repeat windows, and the customer feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.config import CommerceConfig
from cartwright.functions.columns import (
    day_between,
    earliest,
    label_rank,
    money_mean,
    money_sum,
    pct,
    period_label,
    raw_day_between,
    ratio,
)
from cartwright.operators.customers import (
    calendar_features,
    days_since_first_visit,
    first_orders,
    point_in_time_features,
    repeat_label,
)
from cartwright.operators.orders import (
    clean_orders,
    first_second_purchase,
    orders_within_days,
)
from cartwright.operators.shape import purchase_rows, shape_events, valid_purchases
from cartwright.operators.shares import share_of_grand_total
from cartwright.sources.schema import feature_schema
from cartwright.sources.staging import stage

SEGMENTS = ("Early Repeat Buyer", "Later Repeat Buyer", "One-Time Buyer")


def orders_in_window(events: DataFrame, config: CommerceConfig, grain: str) -> DataFrame:
    """Clean orders, stored once: the reports read them up to three times."""
    inside = events.where(
        raw_day_between("event_date", config.orders_from, config.orders_until)
    )
    purchases = valid_purchases(purchase_rows(shape_events(inside)))
    return stage(clean_orders(purchases, grain), "orders")


def eligible_customers(orders: DataFrame, config: CommerceConfig, first: str) -> DataFrame:
    """Customers whose first purchase leaves time for the whole outcome window."""
    return first_second_purchase(orders, first).where(
        day_between("first_purchase_date", config.eligible_from, config.eligible_until)
    )


def customer_segments(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """One row per eligible customer with window value and lifecycle segment."""
    orders = orders_in_window(events, config, "user")
    customers = orders_within_days(
        eligible_customers(orders, config, "min"), orders, config.outcome_days
    )
    gap = F.col("days_to_second_purchase")
    early, later, once = SEGMENTS
    return customers.withColumn(
        "customer_segment",
        F.when(gap.between(0, config.early_days), early)
        .when(gap.between(config.early_days + 1, config.outcome_days), later)
        .otherwise(once),
    )


def lifecycle_segments(events: DataFrame, config: CommerceConfig) -> DataFrame:
    d = config.outcome_days
    totals = customer_segments(events, config).groupBy("customer_segment").agg(
        F.count("*").alias("customers"),
        F.avg("orders_in_window").alias("orders_mean"),
        money_mean("revenue_in_window").alias("revenue_mean"),
        F.avg("items_in_window").alias("items_mean"),
        F.sum("orders_in_window").alias("orders_sum"),
        money_sum("revenue_in_window").alias("revenue_sum"),
    )
    return totals.select(
        "customer_segment",
        "customers",
        share_of_grand_total("customers").alias("customer_share_pct"),
        F.round("orders_mean", 2).alias(f"avg_orders_{d}d"),
        F.round("revenue_mean", 2).alias(f"avg_revenue_{d}d"),
        F.round("items_mean", 2).alias(f"avg_items_{d}d"),
        ratio("revenue_sum", "orders_sum").alias(f"avg_order_value_{d}d"),
        F.round("revenue_sum", 2).alias(f"total_segment_revenue_{d}d"),
        share_of_grand_total("revenue_sum").alias("revenue_share_pct"),
    ).orderBy(label_rank("customer_segment", SEGMENTS))


def repeat_purchase_windows(events: DataFrame, config: CommerceConfig) -> DataFrame:
    d = config.outcome_days
    orders = orders_in_window(events, config, "session").drop("item_quantity")
    customers = orders_within_days(eligible_customers(orders, config, "rank"), orders, d)
    gap = F.col("days_to_second_purchase")
    repeats = {h: F.count_if(gap.between(0, h)) for h in config.repeat_horizons}
    counts = (
        customers.groupBy(
            period_label("first_purchase_date", config.purchase_periods).alias(
                "first_purchase_period"
            )
        )
        .agg(
            F.count("*").alias("first_time_purchasers"),
            *[n.alias(f"repeat_purchasers_{h}d") for h, n in repeats.items()],
            F.round(F.avg(F.when(gap.between(0, d), gap)), 2).alias(
                "avg_days_to_second_purchase"
            ),
            F.round(F.avg("orders_in_window"), 2).alias(f"avg_orders_per_customer_{d}d"),
            F.round(money_mean("revenue_in_window"), 2).alias(f"avg_revenue_per_customer_{d}d"),
        )
        .orderBy(
            label_rank("first_purchase_period", [p.label for p in config.purchase_periods])
        )
    )
    return counts.select(
        "first_purchase_period",
        "first_time_purchasers",
        *[f"repeat_purchasers_{h}d" for h in repeats],
        *[
            pct(f"repeat_purchasers_{h}d", "first_time_purchasers").alias(
                f"repeat_purchase_rate_{h}d_pct"
            )
            for h in repeats
        ],
        "avg_days_to_second_purchase",
        f"avg_orders_per_customer_{d}d",
        f"avg_revenue_per_customer_{d}d",
    )


def feature_events(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """Events the features may use; channel gaps become ``(unknown)``."""
    inside = events.where(
        raw_day_between("event_date", config.feature_events_from, config.orders_until)
    )
    return shape_events(inside).withColumns(
        {c: F.coalesce(c, F.lit("(unknown)")) for c in ("first_source", "first_medium")}
    )


def eligible_first_orders(shaped: DataFrame, config: CommerceConfig) -> DataFrame:
    """First orders dated inside the eligibility window, stored once for the joins to come."""
    attributes = {
        name: earliest(name) for name in ("device_category", "first_source", "first_medium")
    }
    orders = clean_orders(valid_purchases(purchase_rows(shaped)), "session", attributes)
    eligible = first_orders(orders).where(
        day_between("order_date", config.eligible_from, config.eligible_until)
    )
    return stage(eligible, "first-orders")


def ml_feature_table(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """One row per customer; nothing after the first order enters the features."""
    shaped = feature_events(events, config)
    customers = point_in_time_features(eligible_first_orders(shaped, config), shaped)
    label = config.label_column
    rows = customers.withColumns(
        {
            **calendar_features(),
            "first_order_date": F.col("order_date"),
            "first_order_revenue": F.round("order_revenue", 2),
            "first_order_items": F.col("item_quantity"),
            "days_first_visit_to_purchase": days_since_first_visit(),
            label: repeat_label(config.outcome_days),
        }
    )
    return rows.select(*feature_schema(label).fieldNames())


def ml_feature_validation(features: DataFrame, config: CommerceConfig) -> DataFrame:
    label = F.col(config.label_column)
    checked = {
        "null_revenue": "first_order_revenue",
        "null_items": "first_order_items",
        "null_device": "device_category",
        "null_source": "first_source",
        "null_medium": "first_medium",
        "null_sessions": "sessions_before_first_purchase",
        "null_days_to_purchase": "days_first_visit_to_purchase",
    }
    counts = features.agg(
        F.count("*").alias("row_count"),
        F.count_distinct("user_pseudo_id").alias("unique_users"),
        F.count_if(label == 1).alias("repeat_buyers"),
        F.count_if(label == 0).alias("one_time_buyers"),
        *[F.count_if(F.col(c).isNull()).alias(name) for name, c in checked.items()],
    )
    return counts.select(
        "row_count",
        "unique_users",
        "repeat_buyers",
        "one_time_buyers",
        pct("repeat_buyers", "row_count").alias("positive_class_pct"),
        *checked,
    )


REPORTS = {f.__name__: f for f in (lifecycle_segments, repeat_purchase_windows, ml_feature_table)}
