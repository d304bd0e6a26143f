"""Business KPIs: session funnels, clean orders, and both over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.config import FUNNEL_STEPS, STEP_FLAGS, CommerceConfig
from cartwright.functions.columns import (
    event_time,
    label_rank,
    money,
    money_mean,
    money_sum,
    pct,
    period_label,
    ratio,
    raw_day_between,
    session_key,
    valid_keys,
    valid_transaction,
)
from cartwright.operators.orders import clean_orders
from cartwright.operators.sessions import (
    SESSION,
    bounds,
    flags,
    holding_any,
    roll_up,
    session_daily_flags,
    session_flags,
)
from cartwright.operators.shape import purchase_rows, shape_events, valid_purchases

MAIN_STEPS = ("session_start", "view_item", "begin_checkout", "purchase")
KPI_STEPS = tuple(s for s in FUNNEL_STEPS if s != "add_shipping_info")


def reached(*flag_names: str) -> Column:
    """Sessions in which all the named flags are set."""
    hit = F.lit(True)
    for name in flag_names:
        hit = hit & (F.col(name) == 1)
    return F.count_if(hit)


def started_counts() -> list[Column]:
    """The four counts of started sessions most reports show."""
    start = "started_session"
    return [
        reached(start).alias("sessions"),
        reached(start, "viewed_item").alias("product_view_sessions"),
        reached(start, "began_checkout").alias("checkout_sessions"),
        reached(start, "purchased").alias("purchase_sessions"),
    ]


def funnel_sessions(events: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """Sessions with at least one of the counted steps."""
    if sessions is None:
        return session_flags(shape_events(events), KPI_STEPS)
    return holding_any(sessions, KPI_STEPS)


def kpi_initial_funnel(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    counts = funnel_sessions(events, sessions).agg(
        F.count("*").alias("total_sessions"),
        reached("viewed_item").alias("product_view_sessions"),
        reached("added_to_cart").alias("cart_sessions"),
        reached("began_checkout").alias("checkout_sessions"),
        reached("added_payment_info").alias("payment_sessions"),
        reached("purchased").alias("purchase_sessions"),
    )
    return counts.select(
        "*",
        pct("product_view_sessions", "total_sessions").alias("session_to_view_pct"),
        pct("checkout_sessions", "product_view_sessions").alias("view_to_checkout_pct"),
        pct("purchase_sessions", "checkout_sessions").alias("checkout_to_purchase_pct"),
        pct("purchase_sessions", "total_sessions").alias("overall_session_conversion_pct"),
    )


def kpi_session_base(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    """Session rows with bounds and reach flags."""
    steps = FUNNEL_STEPS[1:]
    if sessions is None:
        rows = roll_up(shape_events(events), FUNNEL_STEPS, [*bounds(), *flags(steps)])
    else:
        rows = holding_any(sessions, FUNNEL_STEPS)
    return (
        rows.orderBy(*SESSION)
        .limit(config.session_rows_shown)
        .select(
            *SESSION,
            session_key().alias("session_key"),
            "first_event_timestamp",
            "last_event_timestamp",
            *[STEP_FLAGS[s] for s in steps],
        )
    )


def kpi_validated_funnel(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    start = "started_session"
    counts = funnel_sessions(events, sessions).agg(
        F.count("*").alias("all_session_keys"),
        reached(start).alias("valid_started_sessions"),
        F.count_if(F.col(start) == 0).alias("session_keys_without_start"),
        reached(start, "viewed_item").alias("view_sessions"),
        reached(start, "viewed_item", "began_checkout").alias("view_to_checkout_sessions"),
        reached(start, "began_checkout", "purchased").alias("checkout_to_purchase_sessions"),
        reached(start, "purchased").alias("purchase_sessions"),
        reached(start, "began_checkout").alias("checkouts"),
    )
    return counts.select(
        "*",
        pct("view_sessions", "valid_started_sessions").alias("session_to_view_pct"),
        pct("view_to_checkout_sessions", "view_sessions").alias("view_to_checkout_pct"),
        pct("checkout_to_purchase_sessions", "checkouts").alias("checkout_to_purchase_pct"),
        pct("purchase_sessions", "valid_started_sessions").alias(
            "overall_session_conversion_pct"
        ),
    ).drop("checkouts")


def kpi_clean_orders(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """Orders shrink to sessions and then to users, so no distinct set is needed."""
    orders = clean_orders(valid_purchases(purchase_rows(shape_events(events))))

    def totals(*extra):
        return [F.sum(c).alias(c) for c in (*SUMS, *extra)]

    per_order = orders.select(
        *SESSION,
        F.lit(1).alias("orders"),
        money("order_revenue").alias("revenue_sum"),
        F.col("order_revenue").isNotNull().cast("int").alias("with_revenue"),
        F.col("item_quantity").alias("items_sold"),
        F.col("item_quantity").isNotNull().cast("int").alias("with_quantity"),
    )
    per_session = per_order.groupBy(*SESSION).agg(*totals())
    per_user = (
        per_session.withColumn("purchasing_sessions", F.lit(1))
        .groupBy("user_pseudo_id")
        .agg(*totals("purchasing_sessions"))
    )
    overall = per_user.withColumn("purchasers", F.lit(1)).agg(
        *totals("purchasing_sessions", "purchasers")
    )
    overall = overall.withColumn("revenue_sum", F.col("revenue_sum").cast("double"))
    return overall.select(
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("orders", "purchasers", "purchasing_sessions")
        ],
        F.round("revenue_sum", 2).alias("revenue"),
        ratio("revenue_sum", "with_revenue").alias("average_order_value"),
        "items_sold",
        ratio("items_sold", "with_quantity").alias("average_items_per_order"),
        ratio("revenue_sum", "purchasers").alias("revenue_per_purchaser"),
    )


SUMS = ("orders", "revenue_sum", "with_revenue", "items_sold", "with_quantity")


def order_totals() -> list[Column]:
    return [
        F.round(money_sum("order_revenue"), 2).alias("revenue"),
        F.round(money_mean("order_revenue"), 2).alias("average_order_value"),
        F.sum("item_quantity").alias("items_sold"),
    ]


def kpi_daily_funnel_orders(events: DataFrame, config: CommerceConfig) -> DataFrame:
    shaped = shape_events(events)
    funnel = session_daily_flags(shaped, MAIN_STEPS).groupBy("event_day").agg(*started_counts())
    orders = (
        clean_orders(valid_purchases(purchase_rows(shaped)), "day_session")
        .groupBy(F.col("order_date").alias("event_day"))
        .agg(F.count("*").alias("orders"), *order_totals())
    )
    return (
        funnel.join(orders, "event_day", "left")
        .select(
            F.col("event_day").alias("event_date"),
            "sessions",
            "product_view_sessions",
            "checkout_sessions",
            "purchase_sessions",
            F.coalesce("orders", F.lit(0)).alias("clean_orders"),
            F.coalesce("revenue", F.lit(0.0)).alias("clean_revenue"),
            "average_order_value",
            F.coalesce("items_sold", F.lit(0)).alias("items_sold"),
            pct("product_view_sessions", "sessions").alias("product_view_rate_pct"),
            pct("purchase_sessions", "sessions").alias("session_conversion_pct"),
            pct("purchase_sessions", "checkout_sessions").alias("checkout_to_purchase_pct"),
        )
        .orderBy("event_date")
    )


def kpi_daily_orders(events: DataFrame, config: CommerceConfig) -> DataFrame:
    return (
        clean_orders(valid_purchases(purchase_rows(shape_events(events))))
        .groupBy(F.to_date(event_time("order_timestamp")).alias("order_date"))
        .agg(
            F.count("*").alias("orders"),
            F.count_distinct("user_pseudo_id").alias("purchasers"),
            *order_totals(),
            F.round(F.avg("item_quantity"), 2).alias("average_items_per_order"),
        )
        .orderBy("order_date")
    )


def kpi_monthly_orders(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """Quality and orders per month from one pass over the purchases."""
    since = events.where(raw_day_between("event_date", config.reliable_from, None))
    purchases = purchase_rows(shape_events(since))
    valid = valid_transaction()
    usable = valid_keys() & valid
    first = F.min(
        F.struct("event_timestamp", "event_id", "purchase_revenue", "total_item_quantity")
    )
    # Purchases that make no order share one key per session and day.
    keys = purchases.groupBy(
        "event_day",
        *SESSION,
        F.when(usable, F.col("transaction_id")).alias("order_id"),
    ).agg(
        F.count("*").alias("events"),
        F.count_if(valid).alias("valid_events"),
        first.alias("first"),
    )
    is_order = F.col("order_id").isNotNull()
    by_user = (
        keys.groupBy("event_day", "user_pseudo_id")
        .agg(
            F.sum("events").alias("events"),
            F.sum("valid_events").alias("valid_events"),
            F.count_if(is_order).alias("orders"),
            F.sum(money(F.when(is_order, F.col("first.purchase_revenue")))).alias("revenue_sum"),
            F.count(F.when(is_order, F.col("first.purchase_revenue"))).alias("with_revenue"),
            F.sum(F.when(is_order, F.col("first.total_item_quantity"))).alias("items_sold"),
        )
        .withColumn("month", F.trunc("event_day", "month"))
    )
    ordered = F.col("orders") > 0
    months = (
        by_user.groupBy("month")
        .agg(
            F.count_distinct(F.when(ordered, F.col("event_day"))).alias("observed_days"),
            F.sum("orders").alias("orders"),
            F.count_distinct(F.when(ordered, F.col("user_pseudo_id"))).alias("purchasers"),
            F.sum("revenue_sum").cast("double").alias("revenue_sum"),
            F.sum("with_revenue").alias("with_revenue"),
            F.sum("items_sold").alias("items_sold"),
            F.sum("valid_events").alias("valid_events"),
            F.sum("events").alias("events"),
        )
        .where(F.col("orders") > 0)
    )
    revenue = F.round("revenue_sum", 2)
    return months.select(
        "month",
        "observed_days",
        "orders",
        "purchasers",
        revenue.alias("revenue"),
        ratio("revenue_sum", "with_revenue").alias("average_order_value"),
        "items_sold",
        ratio(revenue, "observed_days").alias("avg_daily_revenue"),
        ratio("orders", "observed_days").alias("avg_daily_orders"),
        pct("valid_events", "events").alias("valid_transaction_pct"),
    ).orderBy("month")


def kpi_period_summary(events: DataFrame, config: CommerceConfig) -> DataFrame:
    first, last = config.window
    shaped = shape_events(events.where(raw_day_between("event_date", first, last)))
    sessions = (
        session_daily_flags(shaped, MAIN_STEPS)
        .groupBy(period_label("event_day", config.periods).alias("period"))
        .agg(F.count_distinct("event_day").alias("days"), *started_counts())
    )
    orders = (
        clean_orders(valid_purchases(purchase_rows(shaped)), "day_session")
        .groupBy(period_label("order_date", config.periods).alias("period"))
        .agg(
            F.count("*").alias("clean_orders"),
            F.count_distinct("user_pseudo_id").alias("purchasers"),
            *order_totals(),
        )
        .withColumnRenamed("revenue", "clean_revenue")
    )
    return (
        sessions.join(orders, "period", "left")
        .select(
            "period",
            "days",
            "sessions",
            "product_view_sessions",
            "checkout_sessions",
            "purchase_sessions",
            "clean_orders",
            "purchasers",
            "clean_revenue",
            "average_order_value",
            "items_sold",
            ratio("sessions", "days").alias("avg_daily_sessions"),
            ratio("clean_orders", "days").alias("avg_daily_orders"),
            ratio("clean_revenue", "days").alias("avg_daily_revenue"),
            pct("purchase_sessions", "sessions").alias("session_conversion_pct"),
            pct("product_view_sessions", "sessions").alias("product_view_rate_pct"),
            pct("purchase_sessions", "checkout_sessions").alias("checkout_to_purchase_pct"),
        )
        .orderBy(label_rank("period", [p.label for p in config.periods]))
    )


REPORTS = {
    f.__name__: f
    for f in (
        kpi_initial_funnel,
        kpi_session_base,
        kpi_validated_funnel,
        kpi_clean_orders,
        kpi_daily_funnel_orders,
        kpi_daily_orders,
        kpi_monthly_orders,
        kpi_period_summary,
    )
}

# Reports that also accept a stored session table.
SESSION_REPORTS = {
    f.__name__: f for f in (kpi_initial_funnel, kpi_session_base, kpi_validated_funnel)
}
