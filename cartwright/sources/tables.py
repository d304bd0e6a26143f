"""Reading and writing events, features and evaluation tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwright.functions.columns import raw_day_between
from cartwright.sources.schema import EVENTS, feature_schema


#: Daily shards of an export are folders or files of this name, ending in ``YYYYMMDD``.
SHARD = "events_"


def _by_day(events: DataFrame) -> DataFrame:
    """Events dealt by day and sorted by type.

    Rebalancing lets Spark split a busy day over several tasks and join small
    days in one, by the sizes it sees at run time. Rows are sorted by event type
    inside a file: the statistics of its pages then let a scan for one type, such
    as purchases, skip the others.
    """
    names = [field.name for field in EVENTS.fields]
    return (
        events.select(*names)
        .hint("rebalance", F.col("event_date"))
        .sortWithinPartitions("event_date", "event_name")
    )


def write_events(events: DataFrame, path: str) -> None:
    """Store events by day in a new store, so date filters skip whole folders."""
    _by_day(events).write.partitionBy("event_date").mode("errorifexists").parquet(path)


def load_days(events: DataFrame, path: str) -> None:
    """Add days to a store, or make one; days that are there already are replaced whole.

    Only folders of days in ``events`` are touched, so loading a day again, after a failure
    or with late events, leaves each event once. An event without a day is an error: no day
    folder could hold it.
    """
    missing = F.raise_error(F.lit("an event has no event_date"))
    day = F.when(F.col("event_date").isNull(), missing).otherwise(F.col("event_date"))
    (
        _by_day(events.withColumn("event_date", day.cast("string")))
        .write.partitionBy("event_date")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def write_shards(events: DataFrame, folder: str, days: list[date]) -> None:
    """One shard a day, as an export delivers them."""
    for day in days:
        raw = day.strftime("%Y%m%d")
        own = events.where(F.col("event_date") == raw)
        own.write.mode("overwrite").parquet(f"{folder}/{SHARD}{raw}")


def read_shards(
    spark: SparkSession, folder: str, first_day: date | None = None, last_day: date | None = None
) -> DataFrame:
    """Events of the daily shards in ``folder``; with both bounds only their days are listed.

    Days between the bounds may be missing, but not all of them. An event keeps the day it
    carries, whatever shard it came in.
    """
    names = "*"
    if first_day is not None and last_day is not None:
        count = (last_day - first_day).days + 1
        days = [(first_day + timedelta(n)).strftime("%Y%m%d") for n in range(count)]
        names = "{" + ",".join(days) + "}"
    shards = spark.read.schema(EVENTS).parquet(f"{folder}/{SHARD}{names}")
    return shards.where(raw_day_between("event_date", first_day, last_day))


def read_events(
    spark: SparkSession, path: str, first_day: date | None = None, last_day: date | None = None
) -> DataFrame:
    """Read stored events; the day bounds prune folders."""
    events = spark.read.schema(EVENTS).parquet(path)
    if first_day is None and last_day is None:
        return events
    return events.where(raw_day_between("event_date", first_day, last_day))


def write_feature_table(features: DataFrame, path: str, label: str) -> None:
    columns = feature_schema(label).fieldNames()
    features.select(*columns).write.mode("overwrite").parquet(path)


def read_feature_table(spark: SparkSession, path: str, label: str) -> DataFrame:
    return spark.read.schema(feature_schema(label)).parquet(path)


def write_feature_csv(features: DataFrame, path: str, label: str) -> None:
    columns = feature_schema(label).fieldNames()
    features.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_feature_csv(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Typed read: the user id stays text and the order date becomes a date."""
    return (
        spark.read.schema(feature_schema(label))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, non-null values, and the table's shape; one pass."""
    fields = df.schema.fields
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count(f"`{f.name}`").alias(f"non_null_{i}") for i, f in enumerate(fields)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col(f"non_null_{i}").alias("non_null"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return counts.select(
        "row_count", F.lit(len(fields)).alias("column_count"), F.inline(rows)
    ).select("column_name", "data_type", "non_null", "row_count", "column_count")


def write_evaluation_tables(tables: dict[str, DataFrame], folder: str, digits: int = 4) -> None:
    """Each table as CSV with a header, doubles rounded."""
    for name, table in tables.items():
        columns = [
            F.round(f.name, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in table.schema.fields
        ]
        table.select(*columns).write.mode("overwrite").option("header", True).csv(
            f"{folder}/{name}"
        )
