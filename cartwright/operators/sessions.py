"""Session rows: reach flags, step times, bounds and first attributes.

All of them are one grouped aggregation with partial results on the map side,
so a session (or user) with very many events shuffles only a few partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.config import FUNNEL_STEPS, STEP_FLAGS
from cartwright.functions.columns import earliest, is_step, valid_keys

SESSION = ("user_pseudo_id", "ga_session_id")
DAY_SESSION = ("event_day", "user_pseudo_id", "ga_session_id")

# Output names of the step times.
STEP_TIMES = {
    "session_start": "session_start_ts",
    "view_item": "view_item_ts",
    "add_to_cart": "add_to_cart_ts",
    "begin_checkout": "begin_checkout_ts",
    "add_shipping_info": "shipping_ts",
    "add_payment_info": "payment_ts",
    "purchase": "purchase_ts",
}


def roll_up(
    shaped: DataFrame,
    steps: tuple[str, ...],
    aggregates: list[Column],
    keys: tuple[str, ...] = SESSION,
) -> DataFrame:
    """Aggregates per session over the events named in ``steps``."""
    kept = shaped.where(F.col("event_name").isin(*steps) & valid_keys())
    return kept.groupBy(*keys).agg(*aggregates)


def flags(steps: tuple[str, ...]) -> list[Column]:
    """0/1 per step: does the session hold such an event?"""
    return [
        F.max(F.when(is_step(step), 1).otherwise(0)).alias(STEP_FLAGS[step]) for step in steps
    ]


def start_date() -> Column:
    """Day of the first session start; NULL for sessions without one."""
    return F.min(F.when(is_step("session_start"), F.col("event_day"))).alias("session_date")


def bounds() -> list[Column]:
    """Times of the first and the last funnel event."""
    inside = F.when(F.col("event_name").isin(*FUNNEL_STEPS), F.col("event_timestamp"))
    return [
        F.min(inside).alias("first_event_timestamp"),
        F.max(inside).alias("last_event_timestamp"),
    ]


def step_times(steps: tuple[str, ...] = FUNNEL_STEPS) -> list[Column]:
    """Earliest time of each step; NULL where it is missing."""
    return [
        F.min(F.when(is_step(step), F.col("event_timestamp"))).alias(STEP_TIMES[step])
        for step in steps
    ]


def first_device() -> Column:
    return earliest("device_category", "session_start").alias("device_category")


def first_channel() -> list[Column]:
    return [earliest(c, "session_start").alias(c) for c in ("first_source", "first_medium")]


def first_viewed_category() -> Column:
    """Category of the first view, which may be missing (NULL) itself."""
    views = F.when(is_step("view_item"), F.struct("event_timestamp", "event_id", "item_category"))
    return F.min_by("item_category", views).alias("first_viewed_category")


def session_table(shaped: DataFrame) -> DataFrame:
    """Everything the session reports read, one row per session.

    Store it and pass it to the reports as ``sessions``: the events are then
    scanned and shuffled once, not once per report.
    """
    return roll_up(
        shaped,
        tuple(STEP_FLAGS),
        [
            start_date(),
            first_device(),
            *first_channel(),
            first_viewed_category(),
            *bounds(),
            *step_times(),
            *flags(tuple(STEP_FLAGS)),
        ],
    )


def holding_any(sessions: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """Sessions with at least one of the steps."""
    return sessions.where(F.greatest(*[F.col(STEP_FLAGS[s]) for s in steps]) == 1)


def session_flags(
    shaped: DataFrame, steps: tuple[str, ...], keys: tuple[str, ...] = SESSION
) -> DataFrame:
    return roll_up(shaped, steps, flags(steps), keys)


def session_daily_flags(shaped: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """Flags per day and session: a session crossing midnight gives two rows."""
    return session_flags(shaped, steps, DAY_SESSION)


def session_step_times(
    shaped: DataFrame, steps: tuple[str, ...] = FUNNEL_STEPS
) -> DataFrame:
    return roll_up(shaped, steps, step_times(steps))


def completeness(sessions: DataFrame) -> DataFrame:
    """Adds whether all core steps were seen, and seen in order (shipping is optional)."""
    core = ["view_item_ts", "add_to_cart_ts", "begin_checkout_ts", "payment_ts", "purchase_ts"]
    complete = F.lit(True)
    for name in core:
        complete = complete & F.col(name).isNotNull()
    ordered = complete
    for before, after in zip(core, core[1:]):
        ordered = ordered & (F.col(before) <= F.col(after))
    return sessions.withColumns(
        {
            "has_all_core_steps": complete,
            "has_ordered_core_funnel": F.coalesce(ordered, F.lit(False)),
        }
    )
