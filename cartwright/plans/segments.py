"""Funnels by device, channel, customer type and product family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.config import FUNNEL_APPAREL_PATTERN, CommerceConfig, Period
from cartwright.functions.columns import (
    day_between,
    family_patterns,
    label_rank,
    pct,
    period_label,
    product_family,
    raw_day_between,
    user_type,
)
from cartwright.operators.sessions import (
    first_channel,
    first_device,
    first_viewed_category,
    flags,
    roll_up,
    start_date,
)
from cartwright.operators.shape import explode_items, shape_events
from cartwright.operators.shares import (
    mix_rate_decomposition,
    share_of_total,
    stack_scopes,
    with_share,
)
from cartwright.plans.audit import distinct_sessions
from cartwright.plans.kpi import MAIN_STEPS, reached, started_counts


def in_periods(sessions: DataFrame, periods: tuple[Period, ...], day: str = "session_date"):
    """Sessions dated inside the span of the periods, labelled."""
    first, last = min(p.start for p in periods), max(p.end for p in periods)
    return sessions.where(day_between(day, first, last)).withColumn(
        "period", period_label(day, periods)
    )


def dated_sessions(
    events: DataFrame,
    steps: tuple[str, ...],
    picks: list[Column],
    periods: tuple[Period, ...],
    sessions: DataFrame | None,
) -> DataFrame:
    """Labelled sessions, from a stored session table or straight from the events."""
    if sessions is None:
        sessions = roll_up(shape_events(events), steps, [start_date(), *picks, *flags(steps)])
    return in_periods(sessions, periods)


def period_order(config: CommerceConfig):
    return label_rank("period", [p.label for p in config.periods])


def funnel_device(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    """Nested rates: the later step is only counted in sessions with the earlier one."""
    start = "started_session"
    counts = (
        dated_sessions(events, MAIN_STEPS, [first_device()], config.periods, sessions)
        .withColumn("device_category", F.coalesce("device_category", F.lit("unknown")))
        .groupBy("period", "device_category")
        .agg(
            *started_counts(),
            reached(start, "viewed_item", "began_checkout").alias("view_then_checkout"),
            reached(start, "began_checkout", "purchased").alias("checkout_then_purchase"),
        )
    )
    return (
        counts.select(
            "*",
            pct("product_view_sessions", "sessions").alias("product_view_rate_pct"),
            pct("view_then_checkout", "product_view_sessions").alias("view_to_checkout_pct"),
            pct("checkout_then_purchase", "checkout_sessions").alias("checkout_to_purchase_pct"),
            pct("purchase_sessions", "sessions").alias("session_conversion_pct"),
        )
        .drop("view_then_checkout", "checkout_then_purchase")
        .orderBy(period_order(config), F.desc("sessions"), "device_category")
    )


def share_and_rates(counts: DataFrame, segment: list[str]) -> DataFrame:
    """Sessions, their share, and the four plain rates."""
    return counts.select(
        "period",
        *segment,
        "sessions",
        "session_share_pct",
        "product_view_sessions",
        "checkout_sessions",
        "purchase_sessions",
        pct("product_view_sessions", "sessions").alias("product_view_rate_pct"),
        pct("checkout_sessions", "product_view_sessions").alias("view_to_checkout_pct"),
        pct("purchase_sessions", "checkout_sessions").alias("checkout_to_purchase_pct"),
        pct("purchase_sessions", "sessions").alias("session_conversion_pct"),
    )


def known_channel(*columns: str) -> dict:
    return {c: F.coalesce(c, F.lit("(unknown)")) for c in columns}


CHANNEL = ["first_source", "first_medium"]


def channel_counts(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    """Sessions and steps per period and channel."""
    return (
        dated_sessions(events, MAIN_STEPS, first_channel(), config.periods, sessions)
        .withColumns(known_channel(*CHANNEL))
        .groupBy("period", *CHANNEL)
        .agg(*started_counts())
    )


def channel_funnel(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    """Small channels are hidden only after the shares are taken."""
    counts = channel_counts(events, config, sessions)
    shares = with_share(counts, "sessions", "period", "session_share_pct")
    return (
        share_and_rates(shares, CHANNEL)
        .where(F.col("sessions") >= config.min_segment_sessions)
        .orderBy(period_order(config), F.desc("sessions"), *CHANNEL)
    )


def channel_starts(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """Session starts as they are, with or without a session id, per period and channel."""
    first, last = config.window
    starts = shape_events(events.where(raw_day_between("event_date", first, last))).where(
        F.col("event_name") == "session_start"
    )
    return (
        in_periods(starts, config.periods, "event_day")
        .withColumns(known_channel(*CHANNEL))
        .groupBy("period", *CHANNEL)
        .agg(F.count("*").alias("sessions"), F.count_distinct("user_pseudo_id").alias("users"))
    )


def channel_mix(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """Session starts of each channel and their share of the period."""
    shares = with_share(channel_starts(events, config), "sessions", "period", "session_share_pct")
    return shares.orderBy(period_order(config), F.desc("sessions"), *CHANNEL)


def customer_new_returning_funnel(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    steps = ("first_visit", *MAIN_STEPS)
    dated = dated_sessions(events, steps, [], config.periods, sessions)
    counts = dated.groupBy("period", user_type().alias("user_type")).agg(*started_counts())
    share = share_of_total("sessions", ["period"])
    return share_and_rates(counts.withColumn("session_share_pct", share), ["user_type"]).orderBy(period_order(config), "user_type")


def counterfactual_names(config: CommerceConfig, names: tuple[str, str, str, str]) -> dict:
    """Output names with the (share period, rate period) each stands for."""
    before, after = config.compare
    pairs = ((0, 0), (1, 1), (0, 1), (1, 0))
    words = {"before": before.slug, "after": after.slug, "short": after.short}
    return {name.format(**words): pair for name, pair in zip(names, pairs)}


def customer_conversion_decomposition(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    steps = ("session_start", "first_visit", "purchase")
    dated = dated_sessions(events, steps, [], config.compare, sessions)
    start = "started_session"
    performance = dated.groupBy("period", user_type().alias("user_type")).agg(
        reached(start).alias("sessions"),
        F.try_divide(reached(start, "purchased"), reached(start)).alias("conversion_rate"),
    )
    names = (
        "actual_{before}_conversion_pct",
        "actual_{after}_conversion_pct",
        "{short}_conversion_with_{before}_mix_pct",
        "{short}_conversion_with_{before}_behavior_pct",
    )
    return mix_rate_decomposition(
        performance,
        tuple(p.label for p in config.compare),
        "user_type",
        "sessions",
        "conversion_rate",
        counterfactual_names(config, names),
    )


def product_category_inventory(events: DataFrame, config: CommerceConfig) -> DataFrame:
    """Viewed items by raw category; rows are merged per session before the distinct counts."""
    views = shape_events(events).where(F.col("event_name") == "view_item")
    category = F.coalesce(F.nullif("item_category", F.lit("")), F.lit("(not set)"))
    merged = (
        explode_items(views)
        .groupBy(category.alias("item_category"), "user_pseudo_id", "ga_session_id")
        .agg(F.count("*").alias("n"))
    )
    return (
        merged.groupBy("item_category")
        .agg(
            F.sum("n").alias("item_event_records"),
            F.count_distinct("user_pseudo_id").alias("users"),
            distinct_sessions().alias("sessions"),
        )
        .orderBy(F.desc("item_event_records"), "item_category")
    )


def family_sessions(
    events: DataFrame,
    steps: tuple[str, ...],
    periods: tuple[Period, ...],
    patterns: tuple[tuple[str, str], ...],
    sessions: DataFrame | None,
) -> DataFrame:
    """Started sessions with a product view, by the family viewed first.

    A view without a category has the family ``(not set)``, so the first view
    decides. The session keeps its raw category and is classified afterwards:
    the patterns then run once per session, not once per view.
    """
    dated = dated_sessions(events, steps, [first_viewed_category()], periods, sessions)
    viewed = dated.where((F.col("started_session") == 1) & (F.col("viewed_item") == 1))
    return viewed.withColumn("product_family", product_family("first_viewed_category", patterns))


def product_mix_decomposition(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    steps = ("session_start", "view_item", "begin_checkout")
    viewed = family_sessions(events, steps, config.compare, family_patterns(), sessions)
    counted = viewed.groupBy("period", "product_family").agg(
        F.count("*").alias("product_view_sessions"),
        F.try_divide(reached("began_checkout"), F.count("*")).alias("view_to_checkout_rate"),
    )
    scoped = stack_scopes(
        counted,
        F.col("product_family") != "(not set)",
        "All product families",
        "Known categories only",
    )
    names = (
        "actual_{before}_view_to_checkout_pct",
        "actual_{after}_view_to_checkout_pct",
        "{short}_rate_with_{before}_product_mix_pct",
        "{short}_rate_with_{before}_family_behavior_pct",
    )
    return mix_rate_decomposition(
        scoped,
        tuple(p.label for p in config.compare),
        "product_family",
        "product_view_sessions",
        "view_to_checkout_rate",
        counterfactual_names(config, names),
        by=("scope",),
    ).orderBy("scope")


def product_family_funnel(
    events: DataFrame, config: CommerceConfig, sessions: DataFrame | None = None
) -> DataFrame:
    patterns = family_patterns(FUNNEL_APPAREL_PATTERN)
    viewed = family_sessions(events, MAIN_STEPS, config.periods, patterns, sessions)
    counts = viewed.groupBy("period", "product_family").agg(
        F.count("*").alias("product_view_sessions"),
        reached("began_checkout").alias("checkout_sessions"),
        reached("purchased").alias("purchase_sessions"),
    )
    return (
        counts.select(
            "period",
            "product_family",
            "product_view_sessions",
            share_of_total("product_view_sessions", ["period"]).alias("product_view_share_pct"),
            "checkout_sessions",
            "purchase_sessions",
            pct("checkout_sessions", "product_view_sessions").alias("view_to_checkout_pct"),
            pct("purchase_sessions", "checkout_sessions").alias("checkout_to_purchase_pct"),
            pct("purchase_sessions", "product_view_sessions").alias(
                "product_view_to_purchase_pct"
            ),
        )
        .where(F.col("product_view_sessions") >= config.min_segment_sessions)
        .orderBy(period_order(config), F.desc("product_view_sessions"), "product_family")
    )


REPORTS = {
    f.__name__: f
    for f in (
        funnel_device,
        channel_funnel,
        channel_mix,
        customer_new_returning_funnel,
        customer_conversion_decomposition,
        product_category_inventory,
        product_mix_decomposition,
        product_family_funnel,
    )
}

# Reports that also accept a stored session table.
SESSION_REPORTS = {
    f.__name__: f
    for f in (
        funnel_device,
        channel_funnel,
        customer_new_returning_funnel,
        customer_conversion_decomposition,
        product_mix_decomposition,
        product_family_funnel,
    )
}
