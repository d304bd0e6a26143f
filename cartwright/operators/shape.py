"""From nested export events to flat columns, and the row filters on them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.functions.columns import (
    day_between,
    event_day,
    event_param,
    placeholder_transaction,
    valid_keys,
    valid_transaction,
)


def shape_events(events: DataFrame) -> DataFrame:
    """Flat view of the events; columns a report does not use are pruned from the scan."""
    return events.select(
        "event_id",
        "event_timestamp",
        "event_date",
        event_day("event_date").alias("event_day"),
        "event_name",
        "user_pseudo_id",
        event_param("ga_session_id").alias("ga_session_id"),
        F.col("device.category").alias("device_category"),
        F.col("traffic_source.source").alias("first_source"),
        F.col("traffic_source.medium").alias("first_medium"),
        F.col("ecommerce.transaction_id").alias("transaction_id"),
        F.col("ecommerce.purchase_revenue").alias("purchase_revenue"),
        F.col("ecommerce.total_item_quantity").alias("total_item_quantity"),
        F.when(
            F.col("event_name") == "view_item", F.get(F.col("items.item_category"), F.lit(0))
        ).alias("item_category"),
        "items",
    )


def explode_items(shaped: DataFrame) -> DataFrame:
    """One row per item; events without items vanish."""
    kept = [c for c in shaped.columns if c not in ("items", "item_category")]
    return shaped.select(*kept, F.inline("items"))


def filter_events(shaped: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return shaped.where(F.col("event_name").isin(*names))


def filter_valid_keys(shaped: DataFrame) -> DataFrame:
    return shaped.where(valid_keys())


def filter_days(shaped: DataFrame, first: date, last: date) -> DataFrame:
    return shaped.where(day_between("event_day", first, last))


def purchase_rows(shaped: DataFrame) -> DataFrame:
    return shaped.where(F.col("event_name") == "purchase").select(
        "event_id",
        "event_timestamp",
        "event_date",
        "event_day",
        "user_pseudo_id",
        "ga_session_id",
        "transaction_id",
        "purchase_revenue",
        "total_item_quantity",
        "device_category",
        "first_source",
        "first_medium",
    )


def valid_purchases(purchases: DataFrame, rule: str = "strict") -> DataFrame:
    """Purchases with user, session and a usable transaction id."""
    return purchases.where(valid_keys() & valid_transaction(rule=rule))


def placeholder_purchases(purchases: DataFrame) -> DataFrame:
    return purchases.where(placeholder_transaction())
