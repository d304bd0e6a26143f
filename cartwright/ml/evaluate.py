"""Classification quality from a label, a predicted class and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.functions.columns import exact_sum
from cartwright.operators.skew import running_totals
from cartwright.sources.staging import stage


def score_curve(
    scored: DataFrame, label: str = "label", score: str = "score", by: tuple[str, ...] = ()
) -> DataFrame:
    """Per distinct score: positives and negatives there, and at or above it.

    Rows shrink to distinct scores before anything is ordered. A missing or NaN score
    is an error.
    """
    value = F.col(score).cast("double")
    known = F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit("a score is missing")))
    counts = stage(
        scored.groupBy(*by, known.otherwise(value).alias("threshold")).agg(
            F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
        ),
        "scores",
    )
    curve = running_totals(counts, "threshold", ["pos", "neg"], by=by, descending=True, stored=True)
    sums = {"all_pos": F.sum("pos"), "all_neg": F.sum("neg")}
    if not by:
        return curve.withColumns({c: counts.agg(total).scalar() for c, total in sums.items()})
    # One row of totals per curve.
    totals = counts.groupBy(*by).agg(*[total.alias(c) for c, total in sums.items()])
    return curve.join(F.broadcast(totals), list(by))


def precision_sum() -> Column:
    """Precision times the step in recall, summed over the thresholds."""
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return exact_sum(precision * F.try_divide("pos", "all_pos"))


def ordered_pairs() -> Column:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    halves = F.lit(2).cast("decimal(20,0)") * F.col("neg") * F.col("cum_pos") - F.col("neg") * F.col("pos")
    pairs = 2.0 * F.max("all_pos") * F.max("all_neg")
    return F.try_divide(F.sum(halves.cast("decimal(38,0)")).cast("double"), pairs)


def average_precision(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(precision_sum().alias("average_precision"))


def roc_auc(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(ordered_pairs().alias("roc_auc"))


def pr_curve(curve: DataFrame) -> DataFrame:
    """Precision and recall when everything from the threshold up is called positive."""
    return curve.select(
        "threshold",
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide("cum_pos", "all_pos").alias("recall"),
    )


def threshold_f1(points: DataFrame, top: int = 10) -> DataFrame:
    """The thresholds with the best F1."""
    precision, recall = F.col("precision"), F.col("recall")
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    best = points.withColumn("f1", f1).orderBy(F.desc_nulls_last("f1"), "threshold").limit(top)
    return best.select(*[F.round(c, 3).alias(c) for c in best.columns])


def confusion_counts(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    return scored.groupBy(
        F.col(label).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(
    scored: DataFrame, label: str = "label", predicted: str = "predicted"
) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    counts = confusion_counts(scored, label, predicted)
    matrix = counts.groupBy("actual").pivot("predicted", [0, 1]).agg(F.sum("n"))
    return matrix.select(
        "actual",
        *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"predicted_{c}") for c in (0, 1)],
    ).orderBy("actual")


def classification_report(
    scored: DataFrame, label: str = "label", predicted: str = "predicted", digits: int = 3
) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages.

    Works on the four confusion counts; a ratio without cases counts as 0.
    """
    counts = confusion_counts(scored, label, predicted)

    def cases(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    actual, guess = F.col("actual"), F.col("predicted")
    per_class = counts.agg(
        cases(actual == guess).alias("right"),
        cases(F.lit(True)).alias("rows"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("class"),
                    cases((actual == c) & (guess == c)).alias("hits"),
                    cases(guess == c).alias("called"),
                    cases(actual == c).alias("support"),
                )
                for c in (0, 1)
            ]
        ).alias("classes"),
    ).select("right", "rows", F.inline("classes"))

    def part(of, whole):
        return F.coalesce(F.try_divide(of, whole), F.lit(0.0))

    measured = per_class.withColumns(
        {"precision": part("hits", "called"), "recall": part("hits", "support")}
    ).withColumn(
        "f1",
        part(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
        ),
    )
    names = ("precision", "recall", "f1")
    classes = measured.select(
        F.col("class").cast("string").alias("row"), *names, F.col("support")
    )
    averages = measured.agg(
        F.max("rows").alias("rows"),
        F.max(part("right", "rows")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[part(F.sum(F.col(c) * F.col("support")), F.max("rows")).alias(f"w_{c}") for c in names],
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(row).alias("row"),
                        *[F.col(source.format(c)).alias(c) for c in names],
                        F.col("rows").alias("support"),
                    )
                    for row, source in (
                        ("accuracy", "accuracy"),
                        ("macro avg", "macro_{}"),
                        ("weighted avg", "w_{}"),
                    )
                ]
            )
        )
    )
    return classes.unionByName(averages).select(
        "row", *[F.round(c, digits).alias(c) for c in names], "support"
    )


def model_scores(scored: DataFrame, label: str, name: str) -> DataFrame:
    """One row: model name, ROC AUC and average precision."""
    return score_curve(scored, label).agg(
        F.lit(name).alias("Model"),
        ordered_pairs().alias("ROC_AUC"),
        precision_sum().alias("PR_AUC"),
    )
