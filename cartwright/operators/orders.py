"""Clean orders and what follows from their sequence per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.functions.columns import money, placeholder_transaction, valid_transaction
from cartwright.operators.sessions import SESSION

GRAINS = {
    "session": ("user_pseudo_id", "ga_session_id", "transaction_id"),
    "day_session": ("event_day", "user_pseudo_id", "ga_session_id", "transaction_id"),
    "user": ("user_pseudo_id", "transaction_id"),
}

HOUR_MICROS = 3_600_000_000


def clean_orders(
    valid: DataFrame, grain: str = "session", earliest_attributes: dict | None = None
) -> DataFrame:
    """One row per order key, with the values of its earliest event.

    ``earliest_attributes`` maps further output names to aggregates.
    """
    keys = GRAINS[grain]
    first = F.min(
        F.struct("event_timestamp", "event_id", "purchase_revenue", "total_item_quantity")
    )
    extra = [agg.alias(name) for name, agg in (earliest_attributes or {}).items()]
    orders = valid.groupBy(*keys).agg(
        first.alias("first"),
        *([] if "event_day" in keys else [F.min("event_day").alias("order_date")]),
        *extra,
    )
    if "event_day" in keys:
        orders = orders.withColumnRenamed("event_day", "order_date")
    return orders.select(
        *[k for k in keys if k != "event_day"],
        "order_date",
        F.col("first.event_timestamp").alias("order_timestamp"),
        F.col("first.purchase_revenue").alias("order_revenue"),
        F.col("first.total_item_quantity").alias("item_quantity"),
        *(earliest_attributes or {}),
    )


def order_sequence(orders: DataFrame) -> list:
    """Time order of a customer's orders, with the order key breaking ties."""
    keys = ["order_timestamp", "transaction_id"]
    return keys + (["ga_session_id"] if "ga_session_id" in orders.columns else [])


def ranked_orders(orders: DataFrame) -> DataFrame:
    """Adds ``purchase_number``, 1 for a customer's first order.

    Orders are ranked inside customer and hour; the orders of earlier hours are
    added from a running total over the hourly counts. No task ranks all orders
    of one customer, and the running total is bounded by the hours covered. The orders of
    one customer in one hour do meet in one task: an automatic buyer with an order a second
    is 3,600 rows there, which one sort in memory takes.
    """
    hourly = orders.withColumn("order_hour", F.expr(f"order_timestamp div {HOUR_MICROS}"))
    in_hour = W.partitionBy("user_pseudo_id", "order_hour").orderBy(*order_sequence(orders))
    earlier_hours = (
        W.partitionBy("user_pseudo_id")
        .orderBy("order_hour")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    before = (
        hourly.groupBy("user_pseudo_id", "order_hour")
        .agg(F.count("*").alias("n"))
        .select(
            "user_pseudo_id",
            "order_hour",
            F.coalesce(F.sum("n").over(earlier_hours), F.lit(0)).alias("orders_before"),
        )
    )
    return (
        hourly.withColumn("number_in_hour", F.row_number().over(in_hour))
        .join(before, ["user_pseudo_id", "order_hour"])
        .select(
            *orders.columns,
            (F.col("orders_before") + F.col("number_in_hour")).cast("int").alias(
                "purchase_number"
            ),
        )
    )


def leading_orders(orders: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` orders of each customer.

    Spark keeps at most ``n`` rows per customer on the map side already, so a
    customer with very many orders does not reach one task whole.
    """
    by_user = W.partitionBy("user_pseudo_id").orderBy(*order_sequence(orders))
    numbered = orders.withColumn("purchase_number", F.row_number().over(by_user))
    return numbered.where(F.col("purchase_number") <= n)


def first_second_purchase(orders: DataFrame, first: str = "rank") -> DataFrame:
    """First and second order date per customer and the days between.

    ``first="rank"`` takes the date of the order ranked 1, ``first="min"`` the
    earliest order date; they differ where days and timestamps disagree.
    """
    by_number = [
        F.min(F.when(F.col("purchase_number") == i, F.col("order_date"))) for i in (1, 2)
    ]
    customers = leading_orders(orders).groupBy("user_pseudo_id").agg(
        by_number[0].alias("first_purchase_date"), by_number[1].alias("second_purchase_date")
    )
    if first == "min":
        earliest = orders.groupBy("user_pseudo_id").agg(
            F.min("order_date").alias("first_purchase_date")
        )
        customers = customers.drop("first_purchase_date").join(earliest, "user_pseudo_id")
    return customers.select(
        "user_pseudo_id",
        "first_purchase_date",
        "second_purchase_date",
        F.datediff("second_purchase_date", "first_purchase_date").alias(
            "days_to_second_purchase"
        ),
    )


def orders_within_days(customers: DataFrame, orders: DataFrame, days: int = 30) -> DataFrame:
    """Orders, revenue and items of each customer from the first date through ``days``.

    Orders are summed per customer and day before the join, so each customer
    brings at most one row per calendar day.
    """
    has_items = "item_quantity" in orders.columns
    daily = orders.groupBy("user_pseudo_id", "order_date").agg(
        F.count("*").alias("orders"),
        F.sum(money("order_revenue")).alias("revenue"),
        *([F.sum("item_quantity").alias("items")] if has_items else []),
    )
    inside = F.col("order_date").between(
        F.col("first_purchase_date"), F.date_add("first_purchase_date", days)
    )
    return (
        daily.join(customers, "user_pseudo_id")
        .where(inside)
        .groupBy(*customers.columns)
        .agg(
            F.sum("orders").alias("orders_in_window"),
            F.sum("revenue").cast("double").alias("revenue_in_window"),
            *([F.sum("items").alias("items_in_window")] if has_items else []),
        )
    )


def transaction_summary(purchases: DataFrame, rule: str = "nonblank") -> DataFrame:
    """Per transaction id: events, users, sessions and revenue versions.

    Equal rows are merged first: the distinct counts then expand those few rows
    rather than every event of a popular id.
    """
    merged = (
        purchases.where(valid_transaction(rule=rule))
        .groupBy("transaction_id", *SESSION, "purchase_revenue")
        .agg(F.count("*").alias("events"))
    )
    return merged.groupBy("transaction_id").agg(
        F.sum("events").alias("purchase_events"),
        F.count_distinct("user_pseudo_id").alias("users"),
        F.count_distinct("user_pseudo_id", "ga_session_id").alias("sessions"),
        F.count_distinct("purchase_revenue").alias("revenue_versions"),
        F.min("purchase_revenue").alias("min_revenue"),
        F.max("purchase_revenue").alias("max_revenue"),
    )


def several_versions(column: str):
    """1 when a group holds more than one distinct non-NULL value, else 0."""
    return F.coalesce((F.min(column) != F.max(column)).cast("int"), F.lit(0))


def order_consistency(purchases: DataFrame) -> DataFrame:
    """Per order key (NULL parts are kept as a key): versions and NULLs of its values.

    Purchases shrink to the versions of each key before versions are counted.
    """
    keys = GRAINS["session"]
    values = ["purchase_revenue", "total_item_quantity"]
    versions = (
        purchases.where(valid_transaction()).groupBy(*keys, *values).agg(F.count("*").alias("n"))
    )

    def without(value: str):
        return F.sum(F.when(F.col(value).isNull(), F.col("n")).otherwise(0))

    return versions.groupBy(*keys).agg(
        F.sum("n").alias("purchase_events"),
        F.count_distinct("purchase_revenue").alias("revenue_versions"),
        F.count_distinct("total_item_quantity").alias("quantity_versions"),
        without("purchase_revenue").alias("null_revenue_events"),
        without("total_item_quantity").alias("null_quantity_events"),
    )


def session_transaction_count(purchases: DataFrame) -> DataFrame:
    """Distinct transaction ids per session."""
    return (
        purchases.where(valid_transaction())
        .groupBy(*SESSION)
        .agg(F.count_distinct("transaction_id").alias("transaction_ids_in_session"))
    )


def placeholder_sessions(purchases: DataFrame) -> DataFrame:
    """Events and revenue versions of each session's purchases without a usable id."""
    versions = (
        purchases.where(placeholder_transaction())
        .groupBy(*SESSION, "purchase_revenue")
        .agg(F.count("*").alias("n"))
    )
    return versions.groupBy(*SESSION).agg(
        F.sum("n").alias("purchase_events"),
        F.count("purchase_revenue").alias("revenue_versions"),
    )
