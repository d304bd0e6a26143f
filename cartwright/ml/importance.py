"""Permutation importance as one distributed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.ml.evaluate import average_precision, score_curve
from cartwright.ml.models import FittedModel
from cartwright.sources.schema import FEATURES
from cartwright.sources.staging import stage


def shuffled_positions(
    keys: DataFrame, key: str, repeats: int, seed: int, digits: int = 3
) -> DataFrame:
    """Position of every row in ``repeats + 1`` random orders of the table.

    A random order sorts by a hash (md5 of key, repeat and seed). Rows are ranked
    inside buckets of the leading hash digits and the sizes of the earlier buckets
    are added, so no task sorts the whole table; ``digits`` only places the work.
    Order 0 is the one the others are compared with.
    """
    orders = keys.select(
        key, F.explode(F.sequence(F.lit(0), F.lit(repeats))).alias("repeat")
    ).withColumn("hash", F.md5(F.concat_ws(":", F.col(key), "repeat", F.lit(seed))))
    placed = orders.withColumn("bucket", F.substring("hash", 1, digits))
    in_bucket = W.partitionBy("repeat", "bucket").orderBy("hash", key)
    earlier = (
        W.partitionBy("repeat").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = (
        placed.groupBy("repeat", "bucket")
        .agg(F.count("*").alias("n"))
        .select(
            "repeat", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
        )
    )
    return (
        placed.withColumn("at", F.row_number().over(in_bucket))
        .join(offsets, ["repeat", "bucket"])
        .select(key, "repeat", (F.col("before") + F.col("at")).alias("position"))
    )


def paired_rows(
    test: DataFrame, label: str, key: str, columns: list[str], repeats: int, seed: int
) -> DataFrame:
    """``repeat, label, own, other``: the columns of each row and of the row in its place.

    In each repeat every row meets the row that took its position; one such pairing serves
    all features.
    """
    positions = stage(shuffled_positions(test.select(key), key, repeats, seed), "positions")
    here = positions.where(F.col("repeat") == 0).select(key, "position")
    there = positions.where(F.col("repeat") > 0)
    values = F.struct(*[F.col(c) for c in columns])
    rows = (
        test.join(here, key)
        .select("position", label, values.alias("own"))
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    )
    donors = test.join(there, key).select("repeat", "position", values.alias("other"))
    return rows.join(donors, ["repeat", "position"]).select("repeat", label, "own", "other")


def swapped(feature: str, column: str, name: str) -> Column:
    """``name`` of the other row if it belongs to ``feature``, else of the row itself."""
    return F.col("other" if column == feature else "own")[name]


def permuted_rows(
    test: DataFrame, label: str, key: str, features: tuple[str, ...], repeats: int, seed: int
) -> DataFrame:
    """For every feature and repeat the test rows with that one column shuffled."""
    pairs = paired_rows(test, label, key, list(features), repeats, seed)
    rows = [
        F.struct(F.lit(f).alias("feature"), *[swapped(f, c, c).alias(c) for c in features])
        for f in features
    ]
    return pairs.select("repeat", label, F.inline(F.array(*rows)))


def scored_by_parts(
    model: FittedModel,
    test: DataFrame,
    label: str,
    key: str,
    features: tuple[str, ...],
    repeats: int,
    seed: int,
) -> DataFrame:
    """``feature, repeat, label, score`` of a linear model with one feature shuffled.

    A shuffled feature changes a margin only by the other row's part in place of its own, so
    the rows are encoded once. Parts are always added in the same order: equal rows keep
    equal scores.
    """
    parts = [f"part__{c}" for c in features]
    rows = stage(model.contributions(test, features).select(key, label, *parts), "parts")

    def score(values: list[Column]) -> Column:
        margin = F.lit(float(model.classifier.intercept))
        for value in values:
            margin = margin + value
        return 1 / (1 + F.exp(-margin))

    pairs = paired_rows(rows, label, key, parts, repeats, seed)
    shuffled = [
        F.struct(
            F.lit(f).alias("feature"),
            score([swapped(f, c, f"part__{c}") for c in features]).alias("score"),
        )
        for f in features
    ]
    plain = rows.select(
        F.lit(0).alias("repeat"),
        label,
        F.lit("").alias("feature"),
        score([F.col(c) for c in parts]).alias("score"),
    )
    return pairs.select("repeat", label, F.inline(F.array(*shuffled))).unionByName(plain)


def permutation_importance(
    model: FittedModel,
    test: DataFrame,
    label: str,
    key: str,
    features: tuple[str, ...] = FEATURES,
    repeats: int = 20,
    seed: int = 42,
    by_parts: bool | None = None,
) -> DataFrame:
    """Mean and spread of the loss in average precision when a feature is shuffled.

    Linear models are scored by their parts, unless ``by_parts`` is false; any other model
    predicts every shuffled copy of the rows.
    """
    if by_parts is None:
        by_parts = getattr(model, "linear", False)
    if by_parts:
        scored = scored_by_parts(model, test, label, key, features, repeats, seed)
    else:
        shuffled = permuted_rows(test, label, key, features, repeats, seed)
        plain = test.select(
            F.lit(0).alias("repeat"), label, F.lit("").alias("feature"), *features
        )
        scored = model.predict(shuffled.unionByName(plain))
    by = ("feature", "repeat")
    scores = stage(average_precision(score_curve(scored, label, by=by), by), "importance")
    plain_score = scores.where(F.col("feature") == "").select("average_precision").scalar()
    drops = scores.where(F.col("feature") != "").select(
        "feature", "repeat", (plain_score - F.col("average_precision")).alias("drop")
    )
    # one number a repeat, added up in the order of the repeats
    of_repeats = drops.groupBy("feature").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("repeat", "drop"))), lambda r: r["drop"]
        ).alias("drops")
    )

    def mean(values):
        return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.size(values)

    found = of_repeats.withColumn("importance", mean("drops"))
    spread = F.transform("drops", lambda x: (x - F.col("importance")) * (x - F.col("importance")))
    return found.select("feature", "importance", F.sqrt(mean(spread)).alias("std")).orderBy(
        F.desc("importance"), "feature"
    )
