"""Repeat-purchase classifiers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.ml.preprocess import (
    Encoding,
    Preprocessing,
    fit_encoding,
    fit_preprocessing,
)

#: Training rows of a task. A fit costs by row and tree or iteration, hardly by byte, while
#: files are cut by size, so the stored rows of many customers would be one task.
ROWS_PER_PART = 10_000


@dataclass(frozen=True)
class FittedModel:
    preprocessing: Preprocessing
    encoding: Encoding
    classifier: object

    @property
    def linear(self) -> bool:
        return hasattr(self.classifier, "coefficients")

    def contributions(self, df: DataFrame, features: tuple[str, ...]) -> DataFrame:
        """Adds ``part__<feature>``: what each feature adds to a linear model's margin.

        A number adds its coefficient times its value, and that of its missing indicator; a
        category the coefficient of its value, found by a join, or nothing if unseen.
        """
        numeric = self.encoding.numeric
        weight = dict(zip(numeric, map(float, self.classifier.coefficients)))
        table = self.encoding.named(self.classifier.coefficients).select(
            "slot", F.col("value").alias("weight")
        )
        categories = self.encoding.category_slots.join(table, "slot")
        rows = self.preprocessing.prepare(df)
        parts = {}
        for c in features:
            if f"num__{c}" in weight:
                own = [n for n in (f"num__{c}", f"num__missingindicator_{c}") if n in weight]
                parts[c] = sum((F.col(n) * weight[n] for n in own[1:]), F.col(own[0]) * weight[own[0]])
            else:
                found = categories.where(F.col("feature") == c).select(
                    F.col("value").alias(f"text__{c}"), F.col("weight").alias(f"weight__{c}")
                )
                rows = rows.join(found, f"text__{c}", "left")
                parts[c] = F.coalesce(f"weight__{c}", F.lit(0.0))
        return rows.select(*df.columns, *[part.alias(f"part__{c}") for c, part in parts.items()])

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds the predicted class and the probability of a repeat purchase."""
        vectors = self.encoding.transform(self.preprocessing.prepare(df))
        scored = self.classifier.transform(vectors)
        return scored.select(
            *df.columns,
            F.col("prediction").cast("int").alias("predicted"),
            vector_to_array("probability")[1].alias("score"),
        )


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class); one row per class."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    classes = W.partitionBy(F.lit(0))
    rows, kinds = F.sum("n").over(classes), F.count("*").over(classes)
    return counts.select(label, F.try_divide(rows, kinds * F.col("n")).alias("class_weight"))


def dealt(rows: DataFrame, columns: list[str], rows_per_part: int) -> DataFrame:
    """``rows`` in parts of about ``rows_per_part``, by ``columns`` and in their order.

    Parts follow from the rows alone, not from files or cores; a table of one part is left
    as it is.
    """
    parts = math.ceil(rows.count() / rows_per_part)
    if parts <= 1:
        return rows
    return rows.repartition(parts, *columns).sortWithinPartitions(*columns)


def fit(train: DataFrame, label: str, classifier, rows_per_part: int = ROWS_PER_PART) -> FittedModel:
    """Preprocessing, encoding and the classifier on the training rows."""
    preprocessing = fit_preprocessing(train)
    prepared = preprocessing.prepare(train)
    encoding = fit_encoding(prepared, preprocessing.imputation)
    vectors = encoding.transform(prepared)
    weighted = vectors.join(F.broadcast(class_weights(train, label)), label)
    weighted = dealt(weighted, train.columns, rows_per_part)
    model = classifier.fit(
        weighted.select("features", F.col(label).cast("double").alias("label"), "class_weight")
    )
    return FittedModel(preprocessing, encoding, model)


def fit_logistic(
    train: DataFrame, label: str, strength: float = 1.0, max_iter: int = 1000
) -> FittedModel:
    """L2-penalised logistic regression.

    The balanced weights sum to the row count, so a penalty of ``1 / (strength *
    rows)`` on the weighted mean loss is the usual inverse-strength penalty on
    the weighted sum.
    """
    rows = train.count()
    classifier = LogisticRegression(
        weightCol="class_weight",
        regParam=1.0 / (strength * rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-9,
    )
    return fit(train, label, classifier)


def fit_forest(
    train: DataFrame,
    label: str,
    trees: int = 300,
    depth: int = 8,
    min_leaf: int = 5,
    seed: int = 42,
) -> FittedModel:
    classifier = RandomForestClassifier(
        weightCol="class_weight",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt",
        seed=seed,
    )
    return fit(train, label, classifier)


def coefficients(model: FittedModel) -> DataFrame:
    """One row per slot of the feature vector."""
    found = model.encoding.named(model.classifier.coefficients)
    value = F.col("value")
    return found.select(
        "feature", value.alias("coefficient"), F.abs(value).alias("abs_coefficient")
    ).orderBy(F.desc("abs_coefficient"), "feature")


def split_importances(model: FittedModel) -> DataFrame:
    """One row per slot: its share of the forest's impurity decrease."""
    found = model.encoding.named(model.classifier.featureImportances.toArray())
    return found.select("feature", F.col("value").alias("split_importance"))


def penalised_gradient(
    model: FittedModel, train: DataFrame, label: str, strength: float = 1.0
) -> DataFrame:
    """Per slot, the gradient of the penalised weighted loss at the fitted coefficients.

    It vanishes at the optimum, which is the only one. Residuals are taken per row and
    summed per slot over the values that are not zero.
    """
    weights = class_weights(train, label)
    y = F.col(label)
    rows = model.classifier.transform(model.encoding.transform(model.preprocessing.prepare(train)))
    residuals = rows.join(F.broadcast(weights), label).select(
        ((vector_to_array("probability")[1] - y) * F.col("class_weight")).alias("residual"),
        F.posexplode(vector_to_array("features")).alias("slot", "value"),
    )
    sums = (
        residuals.where(F.col("value") != 0)
        .groupBy("slot")
        .agg(F.sum(F.col("residual") * F.col("value")).alias("loss"))
    )
    slots = model.encoding.named(model.classifier.coefficients)
    return slots.join(sums, "slot", "left").select(
        "feature",
        (F.col("value") / strength + F.coalesce("loss", F.lit(0.0))).alias("gradient"),
    )


def top_signed(coefs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest and the ``n`` smallest coefficients."""
    up = coefs.orderBy(F.desc("coefficient"), "feature").limit(n)
    down = coefs.orderBy("coefficient", "feature").limit(n)
    return up.select(F.lit("positive").alias("direction"), "feature", "coefficient").unionByName(
        down.select(F.lit("negative").alias("direction"), "feature", "coefficient")
    )
