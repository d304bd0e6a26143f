"""Exact stratified split that never ranks a whole class in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def class_quotas(counts: DataFrame, label: str, test: float) -> DataFrame:
    """Test rows per class from the class sizes.

    The training part gets ``rows - ceil(test * rows)``, shared out by largest
    remainder (the smaller label first on ties); the rest of a class is for test.
    """
    everything = W.partitionBy(F.lit(0))
    rows = F.sum("n").over(everything)
    train = counts.withColumn("rows", rows).withColumn(
        "train", F.col("rows") - F.ceil(F.round(test * F.col("rows"), 6)).cast("long")
    )
    shared = train.withColumns(
        {"base": F.expr("(train * n) div rows"), "rest": F.expr("(train * n) % rows")}
    )
    place = F.row_number().over(everything.orderBy(F.desc("rest"), label))
    left = F.col("train") - F.sum("base").over(everything)
    return shared.withColumns({"place": place, "left": left}).select(
        label,
        (F.col("n") - F.col("base") - (F.col("place") <= F.col("left")).cast("long")).alias(
            "test_rows"
        ),
    )


def stratified_split(
    df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``split`` (train or test) with exact counts per class.

    Each class is ordered by a hash of its key and its first rows are the test
    part. The class is counted by hash prefix; only the bucket holding the cut
    is ranked, to find the cut itself. All rows are then compared with the cut
    of their class, which takes no shuffle.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    bucket = F.substring("_hash", 1, 3).alias("_bucket")
    buckets = hashed.groupBy(label, bucket).agg(F.count("*").alias("n"))
    # From here on: at most 4096 buckets per class.
    earlier = W.partitionBy(label).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = buckets.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    quotas = class_quotas(buckets.groupBy(label).agg(F.sum("n").alias("n")), label, test)
    cut_buckets = (
        before.join(F.broadcast(quotas), label)
        .where(
            (F.col("before") < F.col("test_rows"))
            & (F.col("test_rows") <= F.col("before") + F.col("n"))
        )
        .select(label, "_bucket", (F.col("test_rows") - F.col("before")).alias("cut_at"))
    )
    in_bucket = W.partitionBy(label, "_bucket").orderBy("_hash", key)
    cuts = (
        hashed.select(label, key, "_hash", bucket)
        .join(F.broadcast(cut_buckets), [label, "_bucket"])
        .withColumn("at", F.row_number().over(in_bucket))
        .where(F.col("at") == F.col("cut_at"))
        .select(label, F.struct("_hash", key).alias("_cut"))
    )
    is_test = F.struct("_hash", key) <= F.col("_cut")
    return (
        hashed.join(F.broadcast(cuts), label, "left")
        .select(*df.columns, F.when(is_test, "test").otherwise("train").alias("split"))
    )


def split_profile(split: DataFrame, label: str) -> DataFrame:
    """Rows and class shares of both parts."""
    counts = split.groupBy("split", label).agg(F.count("*").alias("rows"))
    part = F.sum("rows").over(W.partitionBy("split"))
    return counts.select(
        "split",
        label,
        "rows",
        F.round(F.try_divide(F.col("rows"), part), 3).alias("class_share"),
        part.alias("part_rows"),
    ).orderBy("split", label)
