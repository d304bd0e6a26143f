"""Builds canonical nested events from the flat driver table ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.sources.schema import DRIVER_EVENTS

HOUR_MICROS = 3_600_000_000
HOUR_KEY = ("user_id", "sub_user", "hour")

# Fixed values of the adapter, in index order.
CLICK_EVENTS = ("add_to_cart", "begin_checkout", "add_payment_info")
ERROR_EVENTS = ("add_shipping_info", "view_search_results")
DEVICES = ("desktop", "mobile", "tablet")
SOURCES = ("google", "(direct)", "<Other>", "google", None)
MEDIA = ("organic", "(none)", "referral", "cpc", None)
#: Days are named in the property's zone, this much behind UTC.
ZONE_MICROS = 8 * 3_600_000_000

CATEGORIES = (
    "Apparel",
    "Men's / Unisex",
    "Drinkware",
    "Bags",
    "Notebooks",
    "Eco-Friendly",
    "Google",
    "Sale",
    "New",
    "Campus Collection",
    "Accessories",
    "Gift Cards",
    "",
    "(not set)",
    None,
)


def pick(index: Column, values: tuple) -> Column:
    """``values[index]``, 0-based; NULL past the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def session_spans(raw: DataFrame, gap_hours: int) -> DataFrame:
    """Session of every sub-user and hour that holds events.

    A gap that ends a session is longer than an hour, so all events of one user
    and hour share a session. Events are therefore first reduced to one row per
    user and hour, which also bounds the window below by the hours covered,
    however many events a single user has.
    """
    hours = raw.groupBy(*HOUR_KEY).agg(
        F.min(F.struct("ets", "event_id")).alias("first"), F.max("ets").alias("last_ets")
    )
    by_user = W.partitionBy("user_id", "sub_user").orderBy("hour")
    idle = F.col("first.ets") - F.lag("last_ets").over(by_user)
    opens = idle.isNull() | (idle > gap_hours * HOUR_MICROS)
    return (
        hours.withColumn("opens", opens)
        .withColumn(
            "session",
            F.last(F.when(F.col("opens"), F.col("first")), ignorenulls=True).over(by_user),
        )
        .select(
            *HOUR_KEY,
            F.expr("session.ets div 1000000").alias("session_id"),
            F.col("session.event_id").alias("session_first_event"),
        )
    )


def with_sessions(raw: DataFrame, gap_hours: int) -> DataFrame:
    """Adds the session id; a left join, so rows without a user stay."""
    if gap_hours < 1:
        raise ValueError("session gaps below one hour are not supported")
    return raw.join(session_spans(raw, gap_hours), list(HOUR_KEY), "left")


def emitted_copies() -> Column:
    """The events one source row turns into: itself, a session start, a repeated purchase."""

    def copies(when, event_name, ets, event_id, value):
        one = F.array(
            F.struct(
                event_name.alias("event_name"),
                ets.alias("event_timestamp"),
                event_id.alias("event_id"),
                value.alias("value"),
            )
        )
        return one if when is None else F.when(when, one).otherwise(F.slice(one, 1, 0))

    name, ets, eid, value = (F.col(c) for c in ("name", "ets", "event_id", "value"))
    starts = (eid == F.col("session_first_event")) & (F.col("k") % 10 != 0)
    repeats = (name == "purchase") & (eid % 9 == 0)
    repeated_value = F.round(value + F.when(eid % 27 == 0, 1.0).otherwise(0.0), 2)
    return F.concat(
        copies(None, name, ets, eid, value),
        copies(F.coalesce(starts, F.lit(False)), F.lit("session_start"), ets, eid, value),
        copies(repeats, name, ets + 1_000_000, eid + 1_000_000_000, repeated_value),
    )


def canonical_events(
    spark: SparkSession, sf_dir: str, split: int = 1, gap_hours: int = 12
) -> DataFrame:
    """Canonical events; ``split`` cuts each user into that many sub-users."""
    source = spark.read.schema(DRIVER_EVENTS).parquet(f"{sf_dir}/events.parquet")
    kind, k = F.col("event_type"), F.col("k")
    name = (
        F.when(kind == "view", "view_item")
        .when(kind == "signup", "first_visit")
        .when(kind == "purchase", "purchase")
        .when(kind == "click", pick(k % 3, CLICK_EVENTS))
        .when(kind == "error", pick(k % 2, ERROR_EVENTS))
    )
    raw = (
        source.withColumns(
            {
                "k": F.get_json_object("props", "$.k").cast("int"),
                "ets": F.unix_micros(F.col("ts").cast("timestamp")),
                "sub_user": F.col("event_id") % split,
            }
        )
        .withColumns({"hour": F.expr(f"ets div {HOUR_MICROS}"), "name": name})
        .select("event_id", "user_id", "sub_user", "hour", "ets", "name", "k", "value")
    )
    rows = with_sessions(raw, gap_hours).select(
        "user_id", "sub_user", "session_id", "k", F.inline(emitted_copies())
    )
    return nested(rows)


def nested(rows: DataFrame) -> DataFrame:
    eid, k, uid = F.col("event_id"), F.col("k"), F.col("user_id")
    event_name = F.col("event_name")
    is_purchase = event_name == "purchase"

    def param(key: str, text: Column, number: Column) -> Column:
        value = F.struct(
            text.cast("string").alias("string_value"), number.cast("long").alias("int_value")
        )
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    page = param("page", F.lit("/"), F.lit(None))
    session = param("ga_session_id", F.lit(None), F.col("session_id"))
    txn = (
        F.when(k < 5, F.lit(None))
        .when(k < 8, "")
        .when(k < 12, "(not set)")
        .otherwise(F.concat(F.lit("T"), k.cast("string"), F.lit("-"), (uid % 5).cast("string")))
    )
    revenue = F.when(eid % 40 != 3, F.col("value"))
    # One to three items; the first one's category is the k-th.
    items = F.array(
        *(
            F.struct(pick((k % 16 + 5 * j) % len(CATEGORIES), CATEGORIES).alias("item_category"))
            for j in range(3)
        )
    )
    shown = (event_name == "view_item") & (k % 16 != 15)
    # The first-touch channel is not the same on every event of a session.
    channel = (uid + (eid % 7 == 0).cast("int")) % len(SOURCES)
    user = F.concat(F.lit("u"), uid.cast("string"), F.lit("_"), F.col("sub_user").cast("string"))
    return rows.select(
        "event_timestamp",
        "event_id",
        "event_name",
        F.when(eid % 61 != 5, user).alias("user_pseudo_id"),
        F.when(eid % 50 == 7, F.array(page)).otherwise(F.array(page, session)).alias("event_params"),
        F.struct(pick(eid % 3, DEVICES).alias("category")).alias("device"),
        F.struct(
            pick(channel, SOURCES).alias("source"), pick(channel, MEDIA).alias("medium")
        ).alias("traffic_source"),
        F.struct(
            F.when(is_purchase, txn).alias("transaction_id"),
            F.when(is_purchase, revenue).alias("purchase_revenue"),
            F.when(is_purchase, (1 + k % 5).cast("long")).alias("total_item_quantity"),
        ).alias("ecommerce"),
        F.slice(items, 1, F.when(shown, 1 + (eid % 3).cast("int")).otherwise(0)).alias("items"),
        F.date_format(
            F.timestamp_micros(F.col("event_timestamp") - ZONE_MICROS), "yyyyMMdd"
        ).alias("event_date"),
    )
