"""Schemas of the event export and of the stored customer feature table."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_PARAMS = T.ArrayType(
    T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField(
                "value",
                T.StructType(
                    [
                        T.StructField("string_value", T.StringType()),
                        T.StructField("int_value", T.LongType()),
                    ]
                ),
            ),
        ]
    )
)

ITEMS = T.ArrayType(T.StructType([T.StructField("item_category", T.StringType())]))

EVENTS = T.StructType(
    [
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("event_params", EVENT_PARAMS),
        T.StructField("device", T.StructType([T.StructField("category", T.StringType())])),
        T.StructField(
            "traffic_source",
            T.StructType(
                [
                    T.StructField("source", T.StringType()),
                    T.StructField("medium", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "ecommerce",
            T.StructType(
                [
                    T.StructField("transaction_id", T.StringType()),
                    T.StructField("purchase_revenue", T.DoubleType()),
                    T.StructField("total_item_quantity", T.LongType()),
                ]
            ),
        ),
        T.StructField("items", ITEMS),
        T.StructField("event_date", T.StringType()),
    ]
)

# The flat driver table the adapter reads.
DRIVER_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

CATEGORICAL_FEATURES = (
    "purchase_day_of_week",
    "purchase_hour_utc",
    "device_category",
    "first_source",
    "first_medium",
)

NUMERIC_FEATURES = (
    "first_order_revenue",
    "first_order_items",
    "sessions_before_first_purchase",
    "product_views_before_purchase",
    "add_to_cart_before_purchase",
    "checkout_events_before_purchase",
    "search_events_before_purchase",
    "days_first_visit_to_purchase",
)

FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES


def feature_schema(label: str) -> T.StructType:
    """The 16 columns of the customer feature table."""
    kinds = {
        "purchase_day_of_week": T.IntegerType(),
        "purchase_hour_utc": T.IntegerType(),
        "device_category": T.StringType(),
        "first_source": T.StringType(),
        "first_medium": T.StringType(),
        "first_order_revenue": T.DoubleType(),
    }
    fields = [
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("first_order_date", T.DateType()),
    ]
    fields += [T.StructField(name, kinds.get(name, T.LongType())) for name in FEATURES]
    fields.append(T.StructField(label, T.IntegerType()))
    return T.StructType(fields)
