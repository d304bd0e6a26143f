"""Imputation, scaling and encoding, fitted on the training part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.ml.stats import exact_medians, most_frequent
from cartwright.operators.skew import numbered
from cartwright.sources.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from cartwright.sources.staging import stage


@dataclass(frozen=True)
class Imputation:
    """A handful of fitted numbers; one entry per feature."""

    medians: dict[str, float]
    indicators: tuple[str, ...]
    modes: dict[str, str]

    @property
    def numeric_columns(self) -> list[str]:
        return [f"num__{c}" for c in NUMERIC_FEATURES] + [
            f"num__missingindicator_{c}" for c in self.indicators
        ]

    def numerics(self, df: DataFrame) -> DataFrame:
        """Median fill, plus 0/1 indicators for columns with NULLs in training."""
        filled = {
            f"num__{c}": F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c)))
            for c in NUMERIC_FEATURES
        }
        missing = {
            f"num__missingindicator_{c}": F.col(c).isNull().cast("double")
            for c in self.indicators
        }
        return df.withColumns({**filled, **missing})

    def categories(self, df: DataFrame) -> DataFrame:
        """Most frequent value for missing categories, all as text."""
        return df.withColumns(
            {
                f"text__{c}": F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c)))
                for c in CATEGORICAL_FEATURES
            }
        )


def stacked(df: DataFrame, columns: tuple[str, ...], kind: str) -> DataFrame:
    """One row per feature value."""
    values = [F.col(c).cast(kind).alias(c) for c in columns]
    return df.select(*values).unpivot([], list(columns), "feature", "value")


def fit_imputation(train: DataFrame) -> Imputation:
    numeric = stacked(train, NUMERIC_FEATURES, "double")
    gaps = numeric.where(F.col("value").isNull()).select("feature").distinct()
    holes = {row["feature"] for row in gaps.collect()}
    medians = exact_medians(numeric, "feature").collect()
    modes = most_frequent(stacked(train, CATEGORICAL_FEATURES, "string"), "feature").collect()
    return Imputation(
        {row["feature"]: row["median"] for row in medians},
        tuple(c for c in NUMERIC_FEATURES if c in holes),
        {row["feature"]: row["mode"] for row in modes},
    )


def fit_scaling(imputed: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a constant column scales by 1."""
    row = imputed.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in columns],
    ).first()
    return {c: (row[f"{c}__mean"], row[f"{c}__std"] or 1.0) for c in columns}


def standardise(imputed: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    return imputed.withColumns(
        {c: (F.col(c) - mean) / std for c, (mean, std) in scaling.items()}
    )


@dataclass(frozen=True)
class Preprocessing:
    imputation: Imputation
    scaling: dict[str, tuple[float, float]]

    def prepare(self, df: DataFrame) -> DataFrame:
        filled = self.imputation.categories(self.imputation.numerics(df))
        return standardise(filled, self.scaling)


def fit_preprocessing(train: DataFrame) -> Preprocessing:
    imputation = fit_imputation(train)
    filled = imputation.numerics(train)
    return Preprocessing(imputation, fit_scaling(filled, imputation.numeric_columns))


@dataclass(frozen=True)
class Encoding:
    """Full one-hot per category, then the numeric and the categorical block as a vector.

    The categories stay a table (``feature, value, index``, by value); the driver holds
    their numbers only. A category unseen in training is all zeros.
    """

    dictionary: DataFrame
    sizes: dict[str, int]
    numeric: list[str]
    encoder: OneHotEncoderModel

    def transform(self, prepared: DataFrame) -> DataFrame:
        rows = with_indices(prepared, self.dictionary, self.sizes)
        hot = [f"cat__{c}" for c in CATEGORICAL_FEATURES]
        assembler = VectorAssembler(inputCols=[*self.numeric, *hot], outputCol="features")
        return assembler.transform(self.encoder.transform(rows))

    @property
    def category_slots(self) -> DataFrame:
        """``feature, value, slot``: the place of every category in the vector."""
        starts, at = {}, len(self.numeric)
        for c in CATEGORICAL_FEATURES:
            starts[c] = at
            at += self.sizes.get(c, 0)
        start = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))
        slot = (start[F.col("feature")] + F.col("index")).cast("int")
        return self.dictionary.select("feature", "value", slot.alias("slot"))

    @property
    def slots(self) -> DataFrame:
        """``slot, feature``: the place of every number and category in the vector."""
        categories = self.category_slots.select(
            "slot", F.concat(F.lit("cat__"), "feature", F.lit("_"), "value").alias("feature")
        )
        numbers = self.dictionary.sparkSession.createDataFrame(
            list(enumerate(self.numeric)), "slot int, feature string"
        )
        return numbers.unionByName(categories)

    def named(self, values) -> DataFrame:
        """``feature, value`` of one number per slot, as a fitted classifier has them."""
        rows = [(i, float(v)) for i, v in enumerate(values)]
        numbers = self.dictionary.sparkSession.createDataFrame(rows, "slot int, value double")
        return self.slots.join(numbers, "slot").select("slot", "feature", "value")


def with_indices(prepared: DataFrame, dictionary: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Adds each category's index by a join; an unseen one gets an index beyond the last."""
    for c in CATEGORICAL_FEATURES:
        own = dictionary.where(F.col("feature") == c).select(
            F.col("value").alias(f"text__{c}"), F.col("index").alias(f"index__{c}")
        )
        unseen = F.lit(float(sizes.get(c, 0)))
        prepared = prepared.join(own, f"text__{c}", "left").withColumn(
            f"index__{c}", F.coalesce(f"index__{c}", unseen)
        )
    return prepared


def fit_encoding(prepared_train: DataFrame, imputation: Imputation) -> Encoding:
    """Distinct categories of the training rows, numbered by value."""
    text = tuple(f"text__{c}" for c in CATEGORICAL_FEATURES)
    found = stacked(prepared_train, text, "string").where("value is not null").distinct()
    found = found.withColumn("feature", F.expr("substring(feature, 7)"))
    places = numbered(found, "feature", "value", "index")
    dictionary = stage(places.withColumn("index", F.col("index").cast("double")), "categories")
    sizes = {r["feature"]: r["count"] for r in dictionary.groupBy("feature").count().collect()}
    encoder = OneHotEncoder(
        inputCols=[f"index__{c}" for c in CATEGORICAL_FEATURES],
        outputCols=[f"cat__{c}" for c in CATEGORICAL_FEATURES],
        handleInvalid="keep",
        dropLast=True,
    ).fit(with_indices(prepared_train, dictionary, sizes))
    return Encoding(dictionary, sizes, imputation.numeric_columns, encoder)
