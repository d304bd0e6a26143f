"""Explicit settings of the reports: every date, threshold and pattern they use.

The defaults describe the public shop sample of November 2020 to January 2021.
Pass another ``CommerceConfig`` for other data.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Event names of the export and the session flag each one sets.
STEP_FLAGS = {
    "session_start": "started_session",
    "first_visit": "first_visit_session",
    "view_item": "viewed_item",
    "add_to_cart": "added_to_cart",
    "begin_checkout": "began_checkout",
    "add_shipping_info": "added_shipping_info",
    "add_payment_info": "added_payment_info",
    "purchase": "purchased",
}

# The purchase funnel in the order a shopper walks through it.
FUNNEL_STEPS = (
    "session_start",
    "view_item",
    "add_to_cart",
    "begin_checkout",
    "add_shipping_info",
    "add_payment_info",
    "purchase",
)

# Transaction ids that stand for "no id".
BLANK_IDS = ("",)
PLACEHOLDER_IDS = ("", "(not set)")

# Product families, first match wins, matched on lower-cased text.
FAMILY_PATTERNS = (
    ("Apparel", "apparel|men's|women's|kids|t-shirts"),
    ("Drinkware", "drinkware|mugs|tumblers|water bottles"),
    ("Bags", "bags|backpacks"),
    ("Stationery", "stationery|notebooks|writing"),
    ("Eco-Friendly", "eco-friendly"),
    ("Shop by Brand", "shop by brand|google|android|youtube"),
    ("Sale", "sale"),
    ("New", "new"),
    ("Campus Collection", "campus collection"),
    ("Lifestyle & Accessories", "lifestyle|small goods|accessories"),
)

# The family funnel doubles the apostrophes, so a plain "men's" does not match there.
FUNNEL_APPAREL_PATTERN = "apparel|men''s|women''s|kids|t-shirts"


@dataclass(frozen=True)
class Period:
    """Inclusive date interval with its report label and column-name forms."""

    label: str
    start: date
    end: date
    slug: str = ""
    short: str = ""


@dataclass(frozen=True)
class CommerceConfig:
    periods: tuple[Period, ...] = (
        Period("Nov 12-30", date(2020, 11, 12), date(2020, 11, 30)),
        Period("December", date(2020, 12, 1), date(2020, 12, 31)),
        Period("Jan 1-25", date(2021, 1, 1), date(2021, 1, 25)),
    )
    compare: tuple[Period, Period] = (
        Period("December", date(2020, 12, 1), date(2020, 12, 31), "december", "dec"),
        Period("January", date(2021, 1, 1), date(2021, 1, 25), "january", "jan"),
    )
    transition_day: date = date(2020, 11, 11)
    audit_month: Period = Period("January", date(2021, 1, 1), date(2021, 1, 31))
    reliable_from: date = date(2020, 11, 12)
    orders_from: date = date(2020, 11, 12)
    orders_until: date = date(2021, 1, 25)
    feature_events_from: date = date(2020, 11, 1)
    eligible_from: date = date(2020, 11, 12)
    eligible_until: date = date(2020, 12, 26)
    purchase_periods: tuple[Period, ...] = (
        Period("Nov 12-30", date(2020, 11, 12), date(2020, 11, 30)),
        Period("Dec 1-26", date(2020, 12, 1), date(2020, 12, 26)),
    )
    early_days: int = 7
    outcome_days: int = 30
    repeat_horizons: tuple[int, ...] = (7, 14, 30)
    partial_cohort_until: date | None = date(2020, 10, 26)
    max_retention_week: int = 8
    summary_weeks: tuple[int, ...] = (1, 2, 4)
    min_segment_sessions: int = 100
    repeated_ids_shown: int = 30
    session_rows_shown: int = 100

    @property
    def window(self) -> tuple[date, date]:
        """First and last day covered by the analysis periods."""
        return min(p.start for p in self.periods), max(p.end for p in self.periods)

    @property
    def label_column(self) -> str:
        return f"repeat_purchase_{self.outcome_days}d"


# Settings for the January 2024 driver tables.
DRIVER_CONFIG = CommerceConfig(
    periods=(
        Period("P1", date(2024, 1, 1), date(2024, 1, 10)),
        Period("P2", date(2024, 1, 11), date(2024, 1, 20)),
        Period("P3", date(2024, 1, 21), date(2024, 1, 30)),
    ),
    compare=(
        Period("P1", date(2024, 1, 1), date(2024, 1, 10), "p1", "p1"),
        Period("P2", date(2024, 1, 11), date(2024, 1, 20), "p2", "p2"),
    ),
    transition_day=date(2024, 1, 11),
    audit_month=Period("January", date(2024, 1, 5), date(2024, 1, 25)),
    reliable_from=date(2024, 1, 3),
    orders_from=date(2024, 1, 1),
    orders_until=date(2024, 1, 30),
    feature_events_from=date(2024, 1, 1),
    eligible_from=date(2024, 1, 1),
    eligible_until=date(2024, 1, 15),
    purchase_periods=(
        Period("Jan 1-7", date(2024, 1, 1), date(2024, 1, 7)),
        Period("Jan 8-15", date(2024, 1, 8), date(2024, 1, 15)),
    ),
    early_days=7,
    outcome_days=14,
    repeat_horizons=(3, 7, 14),
    partial_cohort_until=date(2023, 12, 25),
    max_retention_week=8,
    summary_weeks=(1, 2, 4),
    min_segment_sessions=10,
)
