"""Invariants of the fitted models and of the quality measures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwright.ml import evaluate, importance, models, preprocess, scoring
from cartwright.sources.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from cartwright.sources.tables import (
    read_feature_csv,
    read_feature_table,
    write_evaluation_tables,
    write_feature_csv,
    write_feature_table,
)
from registry import inputs

SF = "/root/testdata/sf0.001"
LABEL, KEY = inputs.LABEL, inputs.KEY


@pytest.fixture(scope="module")
def parts(spark):
    return inputs.part(spark, SF, "train"), inputs.part(spark, SF, "test")


@pytest.fixture(scope="module")
def logistic(spark):
    return inputs.model(spark, SF, "logistic")


def test_gradient_vanishes_at_the_fit(parts, logistic):
    train, _ = parts
    vectors = logistic.encoding.transform(logistic.preprocessing.prepare(train))
    rows = vectors.select("features", LABEL).collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r[LABEL] for r in rows])
    weight = len(y) / (2 * np.bincount(y)[y])
    w = np.array(logistic.classifier.coefficients)
    p = 1 / (1 + np.exp(-(x @ w + logistic.classifier.intercept)))
    gradient = w + x.T @ (weight * (p - y))
    assert np.abs(gradient).max() < 1e-3
    assert abs((weight * (p - y)).sum()) < 1e-3


def names_of(model):
    return [r.feature for r in model.encoding.slots.orderBy("slot").collect()]


def test_feature_names_match_the_vector(logistic):
    names = names_of(logistic)
    assert len(names) == len(logistic.classifier.coefficients)
    assert [n for n in names if n.startswith("num__")][:8] == [
        f"num__{c}" for c in NUMERIC_FEATURES
    ]
    assert not [n for n in names if n.endswith("__unknown")]


def test_vector_slots_follow_the_dictionary(parts, logistic):
    """Each row's ones stand in the slots of its own categories."""
    train, _ = parts
    names = names_of(logistic)
    vectors = logistic.encoding.transform(logistic.preprocessing.prepare(train))
    for row in vectors.limit(30).collect():
        hot = {n for n, v in zip(names, row.features.toArray()) if n.startswith("cat__") and v}
        assert hot == {f"cat__{c}_{row[f'text__{c}']}" for c in CATEGORICAL_FEATURES}


def test_unseen_category_is_all_zeros(parts, logistic):
    _, test = parts
    odd = test.limit(1).withColumns(
        {c: F.lit("unseen") for c in ("device_category", "first_source", "first_medium")}
    )
    vectors = logistic.encoding.transform(logistic.preprocessing.prepare(odd))
    values = dict(zip(names_of(logistic), vectors.first().features.toArray()))
    for column in ("device_category", "first_source", "first_medium"):
        assert not any(v for n, v in values.items() if n.startswith(f"cat__{column}_"))


def test_shuffling_an_ignored_column_costs_nothing(spark, parts, logistic):
    _, test = parts
    scores = importance.permutation_importance(logistic, test, LABEL, KEY, repeats=3)
    assert scores.count() == 13
    kept = [c for c in NUMERIC_FEATURES if c != "first_order_items"]

    class Blind:
        """Scores by one column only."""

        def predict(self, df):
            return df.withColumn("score", F.col("first_order_items").cast("double"))

    drops = importance.permutation_importance(Blind(), test, LABEL, KEY, repeats=3).collect()
    assert all(r.importance == 0 and r["std"] == 0 for r in drops if r.feature in kept)
    assert len(CATEGORICAL_FEATURES) + len(NUMERIC_FEATURES) == len(drops)


def test_perfect_and_reversed_scores(spark):
    rows = [(int(i >= 6), float(i), int(i >= 6)) for i in range(10)]
    df = spark.createDataFrame(rows, "label int, score double, predicted int")
    for frame, auc in ((df, 1.0), (df.withColumn("score", -F.col("score")), 0.0)):
        curve = evaluate.score_curve(frame)
        assert evaluate.roc_auc(curve).first().roc_auc == auc
    assert evaluate.average_precision(evaluate.score_curve(df)).first()[0] == 1.0
    report = {r.row: r for r in evaluate.classification_report(df).collect()}
    assert report["accuracy"].f1 == 1.0 and report["1"].support == 4


def test_curve_ends_at_full_recall(spark):
    df = inputs.scored_documents(spark, SF)
    points = evaluate.pr_curve(evaluate.score_curve(df)).orderBy("threshold").collect()
    assert points[0].recall == 1.0
    assert all(a.recall >= b.recall for a, b in zip(points, points[1:]))
    assert evaluate.threshold_f1(evaluate.pr_curve(evaluate.score_curve(df))).count() == 10


def test_forest_settings(spark, parts):
    train, test = parts
    forest = models.fit_forest(train, LABEL, trees=5)
    assert forest.classifier.getNumTrees == 5
    assert forest.classifier.getOrDefault("minInstancesPerNode") == 5
    assert forest.predict(test).where("score between 0 and 1").count() == test.count()


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    scaling = preprocess.fit_scaling(df, ["x"])
    assert scaling == {"x": (2.0, 1.0)}
    assert [r.x for r in preprocess.standardise(df, scaling).collect()] == [0.0, 0.0]


def test_feature_files_round_trip(spark, parts, tmp_path):
    train, _ = parts
    write_feature_table(train, f"{tmp_path}/p", LABEL)
    write_feature_csv(train, f"{tmp_path}/c", LABEL)
    for stored in (
        read_feature_table(spark, f"{tmp_path}/p", LABEL),
        read_feature_csv(spark, f"{tmp_path}/c", LABEL),
    ):
        assert stored.columns == train.columns
        assert stored.exceptAll(train).count() == 0 and stored.count() == train.count()


def test_evaluation_tables_are_rounded(spark, logistic, tmp_path):
    table = models.coefficients(logistic)
    write_evaluation_tables({"coefficients": table}, str(tmp_path))
    back = spark.read.option("header", True).csv(f"{tmp_path}/coefficients")
    assert back.columns == ["feature", "coefficient", "abs_coefficient"]
    assert back.count() == table.count()
    assert all(len(r.abs_coefficient.split(".")[1]) <= 4 for r in back.collect() if "E" not in r.abs_coefficient)


def test_top_signed_coefficients(spark, logistic):
    top = models.top_signed(models.coefficients(logistic), 3).collect()
    assert [r.direction for r in top] == ["positive"] * 3 + ["negative"] * 3


def agrees(model, table, rows):
    both = model.predict(rows).select(KEY, "score").join(table, KEY).collect()
    assert len(both) == rows.count()
    return max(abs(r.score - r.table_score) for r in both)


def with_odd_values(rows):
    """The rows, one without numbers and texts, one with unseen categories."""
    first = rows.limit(1)
    empty = first.withColumn(KEY, F.lit("empty")).withColumns(
        {
            c: F.lit(None).cast(rows.schema[c].dataType)
            for c in (*NUMERIC_FEATURES, "first_source", "first_medium")
        }
    )
    unseen = first.withColumn(KEY, F.lit("unseen")).withColumns(
        {c: F.lit("unseen") for c in ("device_category", "first_source", "first_medium")}
    )
    return rows.unionByName(empty).unionByName(unseen)


def test_coefficient_table_scores_as_the_classifier(parts, logistic):
    rows = with_odd_values(parts[1])
    assert agrees(logistic, scoring.linear_scores(logistic, rows, KEY), rows) < 1e-12


def test_node_table_scores_as_the_forest(spark, parts):
    train, test = parts
    forest = models.fit_forest(train, LABEL, trees=12, depth=4)
    nodes = scoring.forest_nodes(forest)
    rows = with_odd_values(test)
    assert agrees(forest, scoring.forest_scores(forest, nodes, rows, KEY, depth=4), rows) < 1e-12
    facts = scoring.forest_facts(nodes, depth=4)
    assert facts.where("depth_kept AND leaves_large AND children_add_up").count() == 12
    # the checks can fail
    assert scoring.forest_facts(nodes, depth=1).where("depth_kept").count() < 12
    assert scoring.forest_facts(nodes, 4, min_leaf=10_000).where("leaves_large").count() == 0
    broken = nodes.withColumn("rows", F.when(F.col("node") == 1, 1).otherwise(F.col("rows")))
    assert scoring.forest_facts(broken, 4).where("NOT children_add_up").count() > 0
    found = dict(scoring.node_importances(nodes).collect())
    own = forest.classifier.featureImportances.toArray()
    assert max(abs(found.get(i, 0.0) - v) for i, v in enumerate(own)) < 1e-9


def test_one_leaf_trees_score_too(parts):
    forest = models.fit_forest(parts[0], LABEL, trees=2, min_leaf=10_000)
    nodes = scoring.forest_nodes(forest)
    assert nodes.count() == 2 and scoring.forest_facts(nodes).where("children_add_up").count() == 2
    rows = parts[1]
    assert agrees(forest, scoring.forest_scores(forest, nodes, rows, KEY), rows) < 1e-12


def test_importance_by_parts_equals_the_general_path(parts, logistic):
    rows = with_odd_values(parts[1])

    def found(by_parts):
        table = importance.permutation_importance(
            logistic, rows, LABEL, KEY, repeats=3, by_parts=by_parts
        )
        return {r.feature: (r.importance, r["std"]) for r in table.collect()}

    parts_found, general = found(True), found(False)
    assert parts_found.keys() == general.keys() and len(general) == 13
    for name, values in general.items():
        assert parts_found[name] == pytest.approx(values, abs=1e-12)
    assert any(v[0] for v in general.values())


def test_training_rows_are_dealt_by_number(parts, monkeypatch):
    """A fit's tasks follow from the rows, whose stored files are few; one part stays as it is."""
    train, _ = parts
    few = train.coalesce(1)
    seen = []

    class Seeing:
        def fit(self, rows):
            seen.append([len(part) for part in rows.rdd.glom().collect()])

    rows = train.count()
    models.fit(few, LABEL, Seeing(), rows_per_part=max(1, rows // 4))
    models.fit(few, LABEL, Seeing())
    assert sum(seen[0]) == sum(seen[1]) == rows
    assert len(seen[0]) >= 4 and max(seen[0]) < rows
    assert len(seen[1]) == 1


def test_dealt_rows_give_the_same_optimum(parts, logistic):
    train, _ = parts
    seen = []

    class Seeing:
        def fit(self, rows):
            seen.append(sorted((r.label, r.class_weight, tuple(r.features)) for r in rows.collect()))

    models.fit(train, LABEL, Seeing(), rows_per_part=5)
    models.fit(train, LABEL, Seeing())
    assert seen[0] == seen[1]


def test_forest_paths_are_dealt_by_number(spark, parts):
    """Rows are few bytes, their paths through all trees many: tasks follow from the paths."""
    _, test = parts
    forest = inputs.model(spark, SF, "forest")
    nodes = inputs.nodes(spark, SF)
    trees = int(forest.classifier.getNumTrees)
    few = scoring.forest_scores(forest, nodes, test, KEY)
    many = scoring.forest_scores(forest, nodes, test, KEY, paths_per_part=trees)
    assert many.rdd.getNumPartitions() == test.count()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
