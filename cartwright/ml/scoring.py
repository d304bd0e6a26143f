"""Fitted models as tables, and scores by joins to them.

The scores of a fitted model come from Spark's own classifiers. Here they are found a second
time from (row, slot, value) entries, a coefficient table and a table of tree nodes, so that
what a model holds can be queried, checked and used without the classifier.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.ml.models import FittedModel
from cartwright.sources.schema import CATEGORICAL_FEATURES
from cartwright.sources.staging import staging_path

#: (row, tree) pairs of a task that sends rows down the trees.
PATHS_PER_PART = 500_000


def entries(model: FittedModel, df: DataFrame, key: str) -> DataFrame:
    """``key, slot, value`` of the slots that a row fills; ``key`` is distinct.

    Numbers fill their slot always, a category fills the slot of its value with one, and a
    category unseen in training fills none.
    """
    prepared = model.preprocessing.prepare(df)
    numeric = model.encoding.numeric
    place = F.create_map(*[F.lit(x) for i, c in enumerate(numeric) for x in (c, i)])
    numbers = prepared.unpivot([key], numeric, "name", "value").select(
        key, place[F.col("name")].alias("slot"), "value"
    )
    names = {c: f"text__{c}" for c in CATEGORICAL_FEATURES}
    texts = prepared.select(key, *[F.col(t).alias(c) for c, t in names.items()])
    categories = (
        texts.unpivot([key], list(names), "feature", "value")
        .join(model.encoding.category_slots, ["feature", "value"])
        .select(key, "slot", F.lit(1.0).alias("value"))
    )
    return numbers.unionByName(categories)


def linear_scores(model: FittedModel, df: DataFrame, key: str) -> DataFrame:
    """``key, table_score``: the logistic function of coefficients times values, per row."""
    coefficients = model.encoding.named(model.classifier.coefficients).select(
        "slot", F.col("value").alias("coefficient")
    )
    margin = F.sum(F.col("value") * F.col("coefficient")) + F.lit(model.classifier.intercept)
    return (
        entries(model, df, key)
        .join(coefficients, "slot")
        .groupBy(key)
        .agg((1 / (1 + F.exp(-margin))).alias("table_score"))
    )


def forest_nodes(model: FittedModel) -> DataFrame:
    """The forest as a table, read from the saved model: one row per tree and node.

    ``tree, node, leaf, rows`` (training rows, repeats by the bootstrap included), ``weights``
    (class weights there), ``gain``, and of inner nodes ``left, right, slot`` and either
    ``threshold`` or ``categories`` (those that go left).
    """
    path = staging_path(model.encoding.dictionary.sparkSession, "forest")
    model.classifier.write().save(path)
    saved = model.encoding.dictionary.sparkSession.read.parquet(f"{path}/data")
    node, split = F.col("nodeData"), F.col("nodeData.split")
    leaf = node["leftChild"] < 0
    by_threshold = ~leaf & (split["numCategories"] < 0)
    rule = split["leftCategoriesOrThreshold"]
    return saved.select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        leaf.alias("leaf"),
        node["rawCount"].alias("rows"),
        node["impurityStats"].alias("weights"),
        F.when(~leaf, node["gain"]).alias("gain"),
        F.when(~leaf, node["leftChild"]).alias("left"),
        F.when(~leaf, node["rightChild"]).alias("right"),
        F.when(~leaf, split["featureIndex"]).alias("slot"),
        F.when(by_threshold, F.get(rule, F.lit(0))).alias("threshold"),
        F.when(~leaf & ~by_threshold, rule).alias("categories"),
    )


def forest_levels(nodes: DataFrame, depth: int) -> DataFrame:
    """``nodes`` that the roots reach in at most ``depth`` steps, with their ``level``."""
    level = nodes.where("node = 0").withColumn("level", F.lit(0))
    found = level
    for at in range(1, depth + 1):
        children = level.where("NOT leaf").select(
            "tree", F.explode(F.array("left", "right")).alias("node")
        )
        level = children.join(nodes, ["tree", "node"]).withColumn("level", F.lit(at))
        found = found.unionByName(level.select(*found.columns))
    return found


def forest_scores(
    model: FittedModel,
    nodes: DataFrame,
    df: DataFrame,
    key: str,
    depth: int = 8,
    paths_per_part: int = PATHS_PER_PART,
) -> DataFrame:
    """``key, table_score``: each row goes down all trees together, a level a join.

    The node table is bounded by the forest's settings (trees times two to the depth) and
    broadcast; the leaves' shares of class 1 are averaged in the order of the trees. Rows are
    dealt by the paths they will make: as rows they are so few bytes that they would be one task.
    """
    trees = int(model.classifier.getNumTrees)
    parts = max(1, math.ceil(df.count() * trees / paths_per_part))
    filled = (
        entries(model, df, key)
        .repartition(parts, key)
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("values"))
    )
    # Numbers stand in the first slots, a category is one in its own: both are short lists.
    width = len(model.encoding.numeric)
    slots = F.sequence(F.lit(0), F.lit(width - 1))
    rows = filled.select(
        key,
        F.transform(slots, lambda slot: F.col("values")[slot]).alias("numbers"),
        F.filter(F.map_keys("values"), lambda slot: slot >= width).alias("ones"),
    )
    at = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "node", F.lit(0)
    )
    inner = F.broadcast(nodes.where("NOT leaf").drop("leaf", "rows", "weights", "gain"))
    slot = F.col("slot")
    value = F.when(
        slot < width, F.coalesce(F.get("numbers", slot), F.lit(0.0))
    ).otherwise(F.array_contains("ones", slot).cast("double"))
    # With exists every level is code of its own. With array_contains all levels become one
    # method, too long for the JVM to compile, and take four times as long.
    goes_left = F.coalesce(
        F.col("threshold") >= value, F.exists("categories", lambda c: c == value), F.lit(False)
    )
    to: Column = F.when(slot.isNull(), F.col("node")).otherwise(
        F.when(goes_left, F.col("left")).otherwise(F.col("right"))
    )
    for _ in range(depth):
        at = at.join(inner, ["tree", "node"], "left").select(
            key, "numbers", "ones", "tree", to.alias("node")
        )
    weight = F.aggregate("weights", F.lit(0.0), lambda total, w: total + w)
    leaves = nodes.where("leaf").select(
        "tree", "node", (F.get("weights", F.lit(1)) / weight).alias("share")
    )
    in_order = F.sort_array(F.collect_list(F.struct("tree", "share")))
    return (
        at.drop("numbers", "ones")
        .join(F.broadcast(leaves), ["tree", "node"])
        .groupBy(key)
        .agg(in_order.alias("shares"))
        .select(
            key,
            (
                F.aggregate("shares", F.lit(0.0), lambda total, s: total + s["share"]) / trees
            ).alias("table_score"),
        )
    )


def forest_facts(nodes: DataFrame, depth: int = 8, min_leaf: int = 5) -> DataFrame:
    """Per tree: whether depth, leaf sizes and the sums of children are as they must be."""
    reached = forest_levels(nodes, depth)
    child = nodes.select("tree", "node", "rows", "weights")

    def under(side: str) -> DataFrame:
        return child.select(
            F.col("tree"), F.col("node").alias(side),
            F.col("rows").alias(f"{side}_rows"), F.col("weights").alias(f"{side}_weights"),
        )

    parents = nodes.where("NOT leaf").join(under("left"), ["tree", "left"]).join(
        under("right"), ["tree", "right"]
    )
    close = F.forall(
        F.arrays_zip("weights", "left_weights", "right_weights"),
        lambda w: F.abs(w["weights"] - w["left_weights"] - w["right_weights"])
        <= 1e-9 * (1 + w["weights"]),
    )
    added = parents.groupBy("tree").agg(
        F.bool_and(close & (F.col("rows") == F.col("left_rows") + F.col("right_rows"))).alias("adds")
    )
    sizes = nodes.groupBy("tree").agg(
        F.count("*").alias("nodes"),
        F.bool_and(~F.col("leaf") | (F.col("rows") >= min_leaf)).alias("leaves_large"),
    )
    shallow = reached.groupBy("tree").agg(F.count("*").alias("reached"))
    return (
        sizes.join(shallow, "tree")
        .join(added, "tree", "left")
        .select(
            "tree",
            (F.col("reached") == F.col("nodes")).alias("depth_kept"),
            "leaves_large",
            F.coalesce("adds", F.lit(True)).alias("children_add_up"),
        )
    )


def node_importances(nodes: DataFrame) -> DataFrame:
    """``slot, importance``: gains by weight, as shares of each tree, as shares of the forest."""
    weight = F.aggregate("weights", F.lit(0.0), lambda total, w: total + w)
    gains = nodes.where("NOT leaf").groupBy("tree", "slot").agg(
        F.sum(F.col("gain") * weight).alias("gain")
    )
    trees = gains.groupBy("tree").agg(F.sum("gain").alias("tree_gain")).where("tree_gain <> 0")
    shares = gains.join(trees, "tree").groupBy("slot").agg(
        F.sum(F.col("gain") / F.col("tree_gain")).alias("share")
    )
    total = shares.agg(F.sum("share")).scalar()
    return shares.select("slot", (F.col("share") / total).alias("importance"))
