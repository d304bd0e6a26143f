"""Column expressions shared by the reports; all of them stay inside the JVM."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwright.config import BLANK_IDS, FAMILY_PATTERNS, PLACEHOLDER_IDS, Period


def event_param(key: str, params: str = "event_params", field: str = "int_value") -> Column:
    """Value of the first parameter called ``key``; NULL when there is none.

    The keys and the values are read as plain arrays: no lambda runs per row, and
    the scan only reads these two leaves of the parameters.
    """
    place = F.array_position(F.col(f"{params}.key"), F.lit(key)).cast("int")
    return F.get(F.col(f"{params}.value.{field}"), place - 1)


def event_day(raw: str = "event_date") -> Column:
    """``YYYYMMDD`` text to a date; malformed text is an error."""
    return F.to_date(raw, "yyyyMMdd")


def event_time(micros: Column | str) -> Column:
    return F.timestamp_micros(micros)


def day_between(day: Column | str, first: date, last: date) -> Column:
    day = F.col(day) if isinstance(day, str) else day
    return day.between(F.lit(first), F.lit(last))


def raw_day_between(raw: str, first: date | None, last: date | None) -> Column:
    """Day bounds on the ``YYYYMMDD`` text itself, so they prune partitions."""
    keep = F.lit(True)
    if first is not None:
        keep = keep & (F.col(raw) >= first.strftime("%Y%m%d"))
    if last is not None:
        keep = keep & (F.col(raw) <= last.strftime("%Y%m%d"))
    return keep


def valid_keys() -> Column:
    return F.col("user_pseudo_id").isNotNull() & F.col("ga_session_id").isNotNull()


def valid_transaction(txn: str = "transaction_id", rule: str = "strict") -> Column:
    """``strict`` rejects NULL, blank and ``(not set)``; ``nonblank`` keeps ``(not set)``."""
    rejected = {"strict": PLACEHOLDER_IDS, "nonblank": BLANK_IDS}[rule]
    return F.col(txn).isNotNull() & ~F.col(txn).isin(*rejected)


def placeholder_transaction(txn: str = "transaction_id") -> Column:
    return F.col(txn).isNull() | F.col(txn).isin(*PLACEHOLDER_IDS)


def session_key() -> Column:
    """Readable ``user-session`` text, for display only."""
    return F.concat(
        F.col("user_pseudo_id"), F.lit("-"), F.col("ga_session_id").cast("string")
    )


def is_step(step: str) -> Column:
    return F.col("event_name") == step


def pct(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """Rounded percentage; NULL when ``whole`` is zero."""
    return F.round(100 * F.try_divide(part, whole), digits)


def ratio(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    return F.round(F.try_divide(part, whole), digits)


#: Decimal places of amounts; a finer amount is an error.
MONEY_SCALE = 2


def money(amount: str | Column, scale: int = MONEY_SCALE) -> Column:
    """A double amount as an exact decimal."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    exact = amount.cast(f"decimal(28, {scale})")
    finer = F.raise_error(F.lit(f"an amount has more than {scale} decimal places"))
    return F.when(amount.isNull() | (exact.cast("double") == amount.cast("double")), exact).otherwise(
        finer
    )


def money_sum(amount: str | Column) -> Column:
    """Sum of amounts, the same in every order and partitioning; cast to double last."""
    return F.sum(money(amount)).cast("double")


def money_mean(amount: str | Column) -> Column:
    return F.try_divide(money_sum(amount), F.count(amount))


def period_label(
    day: Column | str, periods: tuple[Period, ...], other: str | None = None
) -> Column:
    """Label of the first period holding ``day``; ``other`` (or NULL) outside all."""
    label = None
    for p in periods:
        hit = day_between(day, p.start, p.end)
        label = F.when(hit, p.label) if label is None else label.when(hit, p.label)
    return label.otherwise(F.lit(other))


def label_rank(label: str, labels: tuple[str, ...] | list[str]) -> Column:
    """Position of a label in a custom order; NULL for a label not listed."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), F.col(label)), F.lit(0))


def phase_label(day: str, transition: date) -> Column:
    """Instrumentation phase; a NULL day counts as stable."""
    return (
        F.when(F.col(day) < F.lit(transition), "Pre-instrumentation")
        .when(F.col(day) == F.lit(transition), "Transition day")
        .otherwise("Stable period")
    )


PHASES = ("Pre-instrumentation", "Transition day", "Stable period")


def family_patterns(apparel: str | None = None) -> tuple[tuple[str, str], ...]:
    """The family list, optionally with another apparel pattern."""
    return tuple(
        (family, apparel if apparel and family == "Apparel" else pattern)
        for family, pattern in FAMILY_PATTERNS
    )


#: Fixed value: the characters that trimming removes, besides the blank.
WHITE_SPACE = (
    " \t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def product_family(
    category: str, patterns: tuple[tuple[str, str], ...] = FAMILY_PATTERNS
) -> Column:
    """Ordered first-match classification; missing categories become ``(not set)``."""
    text = F.lower(category)
    blank = F.btrim(category, F.lit(WHITE_SPACE)) == ""
    missing = F.col(category).isNull() | blank | (text == "(not set)")
    family = F.when(missing, "(not set)")
    for name, pattern in patterns:
        family = family.when(text.rlike(pattern), name)
    return family.otherwise("Other")


def user_type(first_visit_flag: str = "first_visit_session") -> Column:
    return F.when(F.col(first_visit_flag) == 1, "New").otherwise("Returning")


def monday(day: str) -> Column:
    return F.trunc(day, "week")


def earliest(value: str, only_event: str | None = None) -> Column:
    """First non-NULL ``value`` in time order, optionally of one event type.

    ``min_by`` skips rows whose ordering is NULL, so the condition sits there. The
    value ends the ordering: exports without event ids give one result in any row order.
    """
    usable = F.col(value).isNotNull()
    if only_event is not None:
        usable = usable & is_step(only_event)
    return F.min_by(value, F.when(usable, F.struct("event_timestamp", "event_id", value)))


def exact_sum(term: Column, scale: int = 18) -> Column:
    """Sum of doubles that does not depend on the order of rows.

    Each term is rounded to ``scale`` decimal places and added up exactly; 38 - ``scale``
    digits are left before the point. A null sum stays null.
    """
    return F.sum(term.cast(f"decimal(38,{scale})")).cast("double")
