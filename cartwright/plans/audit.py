"""Data-quality reports over the event export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.config import FUNNEL_STEPS, CommerceConfig
from cartwright.functions.columns import (
    PHASES,
    event_time,
    label_rank,
    money,
    pct,
    phase_label,
    placeholder_transaction,
    raw_day_between,
    session_key,
    valid_keys,
    valid_transaction,
)
from cartwright.operators.orders import GRAINS, several_versions, transaction_summary
from cartwright.operators.sessions import SESSION, completeness, session_step_times
from cartwright.operators.shape import (
    filter_events,
    placeholder_purchases,
    purchase_rows,
    shape_events,
    valid_purchases,
)


def distinct_sessions():
    """Distinct (user, session) pairs; a pair with a NULL part does not count."""
    return F.count_distinct(*SESSION)


def dq_event_inventory(events: DataFrame, config: CommerceConfig) -> DataFrame:
    return (
        events.groupBy("event_name")
        .agg(F.count("*").alias("event_count"), F.count_distinct("user_pseudo_id").alias("users"))
        .orderBy(F.desc("event_count"), "event_name")
    )


def dq_session_id_coverage(events: DataFrame, config: CommerceConfig) -> DataFrame:
    return (
        filter_events(shape_events(events), FUNNEL_STEPS)
        .groupBy("event_name")
        .agg(
            F.count("*").alias("event_count"),
            F.count_if(F.col("ga_session_id").isNull()).alias("missing_session_id"),
            distinct_sessions().alias("sessions"),
        )
        .orderBy(label_rank("event_name", FUNNEL_STEPS))
    )


def dq_sessions_by_event(events: DataFrame, config: CommerceConfig) -> DataFrame:
    return (
        filter_events(shape_events(events), FUNNEL_STEPS)
        .groupBy("event_name")
        .agg(distinct_sessions().alias("sessions"))
        .orderBy(label_rank("event_name", FUNNEL_STEPS))
    )


def dq_funnel_event_inventory(events: DataFrame, config: CommerceConfig) -> DataFrame:
    return (
        filter_events(shape_events(events), FUNNEL_STEPS)
        .groupBy("event_name")
        .agg(F.count("*").alias("event_count"), F.count_distinct("user_pseudo_id").alias("users"))
        .orderBy(label_rank("event_name", FUNNEL_STEPS))
    )


def dq_purchase_transactions(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """One row over all purchases.

    Rows are merged per session and id first: the two distinct counts then
    expand merged rows, not every purchase.
    """
    merged = (
        purchase_rows(shape_events(events))
        .groupBy(*SESSION, "transaction_id")
        .agg(F.count("*").alias("n"), F.sum(money("purchase_revenue")).alias("revenue"))
    )
    missing = F.col("transaction_id").isNull() | (F.col("transaction_id") == "")
    return merged.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("purchase_events"),
        F.coalesce(F.sum(F.when(missing, F.col("n")).otherwise(0)), F.lit(0)).alias(
            "missing_transaction_id"
        ),
        F.count_distinct("transaction_id").alias("unique_transaction_ids"),
        distinct_sessions().alias("purchase_sessions"),
        F.round(F.sum("revenue").cast("double"), 2).alias("summed_purchase_revenue"),
    )


def dq_transaction_integrity(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """Purchases are read once: NULL and blank ids are groups of their own.

    "More than one user" only needs the smallest and the largest user to differ,
    so no distinct sets are built.
    """
    whole_session = F.when(valid_keys(), F.struct(*SESSION))
    per_id = (
        purchase_rows(shape_events(events))
        .withColumn("whole_session", whole_session)
        .groupBy("transaction_id")
        .agg(
            F.count("*").alias("n"),
            several_versions("user_pseudo_id").alias("many_users"),
            several_versions("whole_session").alias("many_sessions"),
            several_versions("purchase_revenue").alias("many_revenues"),
        )
    )
    valid = valid_transaction(rule="nonblank")

    def events_where(condition, name):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    return per_id.agg(
        events_where(F.col("transaction_id").isNull(), "null_transaction_ids"),
        events_where(F.col("transaction_id") == "", "blank_transaction_ids"),
        F.count_if(valid).alias("valid_unique_transactions"),
        F.count_if(valid & (F.col("n") > 1)).alias("duplicated_transaction_ids"),
        F.sum(F.when(valid, F.col("n"))).alias("purchase_events_with_valid_id"),
        F.max(F.when(valid, F.col("n"))).alias("max_events_per_transaction"),
        F.count_if(valid & (F.col("many_users") == 1)).alias("transaction_ids_multiple_users"),
        F.count_if(valid & (F.col("many_sessions") == 1)).alias(
            "transaction_ids_multiple_sessions"
        ),
        F.count_if(valid & (F.col("many_revenues") == 1)).alias(
            "transaction_ids_revenue_mismatch"
        ),
    )


def dq_repeated_transactions(events: DataFrame, config: CommerceConfig) -> DataFrame:
    return (
        transaction_summary(purchase_rows(shape_events(events)))
        .where(F.col("purchase_events") > 1)
        .orderBy(F.desc("purchase_events"), "transaction_id")
        .limit(config.repeated_ids_shown)
    )


def dq_composite_order_grain(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """Three grains from one pass over the purchases.

    Purchases shrink to order keys (placeholder ids share one key per session),
    the keys to sessions, the sessions to the row of counts.
    """
    purchases = purchase_rows(shape_events(events)).withColumn(
        "order_id", F.when(valid_transaction(), F.col("transaction_id"))
    )
    keys = purchases.groupBy(*SESSION, "order_id").agg(
        F.count("*").alias("n"), several_versions("purchase_revenue").alias("many_revenues")
    )
    is_order = F.col("order_id").isNotNull()
    is_placeholder = F.col("order_id").isNull()

    def total(condition):
        return F.count_if(condition)

    sessions = keys.groupBy(*SESSION).agg(
        total(is_order).alias("orders"),
        total(is_order & (F.col("n") > 1)).alias("repeated_orders"),
        total(is_order & (F.col("many_revenues") == 1)).alias("mismatches"),
        F.max(F.when(is_order, F.col("n"))).alias("largest_order"),
        total(is_placeholder).alias("placeholder"),
        total(is_placeholder & (F.col("n") > 1)).alias("repeated_placeholder"),
        total(is_placeholder & (F.col("many_revenues") == 1)).alias("placeholder_revenues"),
    )

    def summed(column, name):
        return F.coalesce(F.sum(column), F.lit(0)).alias(name)

    return sessions.agg(
        summed("orders", "composite_orders"),
        summed("repeated_orders", "repeated_composite_orders"),
        summed("mismatches", "composite_revenue_mismatches"),
        F.max("largest_order").alias("max_events_per_composite_order"),
        F.count_if(F.col("orders") > 1).alias("sessions_with_multiple_transaction_ids"),
        summed("placeholder", "placeholder_purchase_sessions"),
        summed("repeated_placeholder", "repeated_placeholder_sessions"),
        summed("placeholder_revenues", "placeholder_sessions_multiple_revenues"),
    )


def dq_placeholder_patterns(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """Placeholder purchases of sessions that have several; NULL keys drop out."""
    placeholders = placeholder_purchases(purchase_rows(shape_events(events))).where(valid_keys())
    repeated = placeholders.groupBy(*SESSION).agg(F.count("*").alias("n")).where("n > 1")
    return (
        placeholders.join(repeated, list(SESSION), "left_semi")
        .orderBy(*SESSION, "event_timestamp", "event_id")
        .select(
            *SESSION,
            event_time("event_timestamp").alias("purchase_time"),
            "purchase_revenue",
            "total_item_quantity",
        )
    )


def purchase_sessions(events: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """Step times of the sessions with a purchase."""
    if sessions is None:
        sessions = session_step_times(shape_events(events))
    return sessions.where(F.col("purchase_ts").isNotNull())


def dq_funnel_completeness(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    counts = completeness(purchase_sessions(events, sessions)).agg(
        F.count("*").alias("purchase_sessions"),
        F.count_if(F.col("view_item_ts").isNull()).alias("missing_view_item"),
        F.count_if(F.col("add_to_cart_ts").isNull()).alias("missing_add_to_cart"),
        F.count_if(F.col("begin_checkout_ts").isNull()).alias("missing_checkout"),
        F.count_if(F.col("shipping_ts").isNull()).alias("missing_shipping"),
        F.count_if(F.col("payment_ts").isNull()).alias("missing_payment"),
        F.count_if("has_all_core_steps").alias("complete_core_funnel"),
        F.count_if("has_ordered_core_funnel").alias("complete_ordered_funnel"),
    )
    return counts.select(
        "*",
        pct("complete_core_funnel", "purchase_sessions").alias("complete_core_pct"),
        pct("complete_ordered_funnel", "purchase_sessions").alias("ordered_core_pct"),
    )


def dq_purchase_paths(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    bought = purchase_sessions(events, sessions)
    shown = bought.orderBy(*SESSION).limit(config.session_rows_shown)
    return shown.select(
        session_key().alias("session_key"),
        event_time("session_start_ts").alias("session_start_time"),
        event_time("view_item_ts").alias("view_item_time"),
        event_time("add_to_cart_ts").alias("add_to_cart_time"),
        event_time("begin_checkout_ts").alias("checkout_time"),
        event_time("shipping_ts").alias("shipping_time"),
        event_time("payment_ts").alias("payment_time"),
        event_time("purchase_ts").alias("purchase_time"),
    )


def dq_daily_coverage(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """Distinct sessions and orders per day from per-key counts, without expanding events."""
    order_id = F.when(valid_transaction(), F.col("transaction_id")).alias("order_id")
    by_key = (
        purchase_rows(shape_events(events))
        .where(valid_keys())
        .groupBy("event_day", *SESSION, order_id)
        .agg(F.count("*").alias("n"))
    )
    is_order = F.col("order_id").isNotNull()
    by_session = by_key.groupBy("event_day", *SESSION).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(is_order, F.col("n")).otherwise(0)).alias("valid"),
        F.count_if(is_order).alias("orders"),
    )
    daily = by_session.groupBy(F.col("event_day").alias("event_date")).agg(
        F.sum("n").alias("purchase_events"),
        F.count("*").alias("purchase_sessions"),
        F.sum("valid").alias("events_with_valid_transaction_id"),
        F.sum(F.col("n") - F.col("valid")).alias("events_with_placeholder_transaction_id"),
        F.sum("orders").alias("clean_orders"),
    )
    return daily.select(
        "*",
        pct("events_with_valid_transaction_id", "purchase_events").alias(
            "valid_transaction_event_pct"
        ),
    ).orderBy("event_date")


def transaction_coverage(purchases: DataFrame, by: str) -> DataFrame:
    """Purchases with a valid and with a placeholder id, per group."""
    counts = purchases.groupBy(by).agg(
        F.count("*").alias("purchase_events"),
        F.count_if(valid_transaction()).alias("valid_transaction_events"),
        F.count_if(placeholder_transaction()).alias("placeholder_events"),
    )
    return counts.select(
        "*",
        pct("valid_transaction_events", "purchase_events").alias("valid_transaction_pct"),
    )


def dq_period_coverage(events: DataFrame, config: CommerceConfig) -> DataFrame:
    purchases = purchase_rows(shape_events(events)).where(valid_keys())
    phased = purchases.withColumn("period", phase_label("event_day", config.transition_day))
    return transaction_coverage(phased, "period").orderBy(label_rank("period", PHASES))


def dq_month_daily_coverage(events: DataFrame, config: CommerceConfig) -> DataFrame:
    month = config.audit_month
    inside = events.where(raw_day_between("event_date", month.start, month.end))
    purchases = purchase_rows(shape_events(inside))
    daily = transaction_coverage(
        purchases.drop("event_date").withColumnRenamed("event_day", "event_date"), "event_date"
    )
    return daily.orderBy("event_date")


def dq_clean_order_quality(events: DataFrame, config: CommerceConfig) -> DataFrame:
    checks = (
        valid_purchases(purchase_rows(shape_events(events)))
        .groupBy(*GRAINS["session"])
        .agg(
            several_versions("purchase_revenue").alias("many_revenues"),
            several_versions("total_item_quantity").alias("many_quantities"),
            F.max(F.col("purchase_revenue").isNull().cast("int")).alias("null_revenue"),
            F.max(F.col("total_item_quantity").isNull().cast("int")).alias("null_quantity"),
        )
    )
    return checks.agg(
        F.count("*").alias("orders"),
        F.count_if(F.col("many_revenues") == 1).alias("revenue_mismatch_orders"),
        F.count_if(F.col("many_quantities") == 1).alias("quantity_mismatch_orders"),
        F.count_if(F.col("null_revenue") == 1).alias("orders_with_null_revenue"),
        F.count_if(F.col("null_quantity") == 1).alias("orders_with_null_quantity"),
    )


REPORTS = {
    f.__name__: f
    for f in (
        dq_event_inventory,
        dq_session_id_coverage,
        dq_sessions_by_event,
        dq_funnel_event_inventory,
        dq_purchase_transactions,
        dq_transaction_integrity,
        dq_repeated_transactions,
        dq_composite_order_grain,
        dq_placeholder_patterns,
        dq_funnel_completeness,
        dq_purchase_paths,
        dq_daily_coverage,
        dq_period_coverage,
        dq_month_daily_coverage,
        dq_clean_order_quality,
    )
}

# Reports that also accept a stored session table.
SESSION_REPORTS = {f.__name__: f for f in (dq_funnel_completeness, dq_purchase_paths)}
