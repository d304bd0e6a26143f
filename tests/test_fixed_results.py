"""Results that must not depend on row order, partitioning or tuning parameters."""

import pytest
from pyspark.sql import functions as F

from cartwright.config import DRIVER_CONFIG
from cartwright.functions.columns import earliest, money_mean, money_sum, product_family
from cartwright.ml import eda
from cartwright.ml.evaluate import score_curve
from cartwright.ml.importance import shuffled_positions
from cartwright.operators import customers, skew
from cartwright.operators.sessions import first_viewed_category
from cartwright.plans import repeat
from cartwright.sources import staging
from registry import inputs

SMALL = "/root/testdata/sf0.001"
LABEL = DRIVER_CONFIG.label_column


def orders_of(df):
    """The same rows in several partitionings and orders."""
    yield df.coalesce(1)
    for parts in (1, 4, 64):
        yield df.repartition(parts)
        yield df.orderBy(F.rand(parts)).coalesce(1)


def test_money_is_exact_in_every_partitioning(spark):
    features = inputs.features(spark, SMALL)
    means = {repr(eda.means_by_target(df, LABEL).collect()) for df in orders_of(features)}
    assert len(means) == 1
    cents = spark.createDataFrame([(i / 100,) for i in range(1, 2000)], "v double")
    sums = {tuple(df.agg(money_sum("v"), money_mean("v")).first()) for df in orders_of(cents)}
    assert sums == {(19990.0, 10.0)}


def test_finer_amounts_are_an_error(spark):
    df = spark.createDataFrame([(1.001,)], "v double")
    with pytest.raises(Exception, match="decimal places"):
        df.agg(money_sum("v")).collect()
    empty = spark.createDataFrame([(None,)], "v double").agg(money_sum("v"), money_mean("v")).first()
    assert tuple(empty) == (None, None)


def test_ties_without_event_ids(spark):
    rows = [(5, None, "view_item", c) for c in ("b", None, "a", "c")]
    df = spark.createDataFrame(
        rows, "event_timestamp long, event_id long, event_name string, item_category string"
    )
    picks = [
        earliest("item_category").alias("first"),
        first_viewed_category().alias("viewed"),
    ]
    found = {tuple(d.agg(*picks).first()) for d in orders_of(df)}
    assert found == {("a", None)}


def test_blank_categories_of_any_white_space(spark):
    rows = [("\t",), ("  \n",), ("",), (None,), (" new\t",)]
    df = spark.createDataFrame(rows, "c string")
    found = [r[0] for r in df.select(product_family("c")).collect()]
    assert found == ["(not set)"] * 4 + ["New"]


@pytest.mark.parametrize("odd", [float("nan"), None])
def test_missing_scores_are_an_error(spark, odd):
    df = spark.createDataFrame([(1, 0.5), (0, odd)], "label int, score double")
    with pytest.raises(Exception, match="score is missing"):
        score_curve(df).collect()


def test_tuning_places_work_only(spark):
    keys = spark.createDataFrame([(f"u{i}",) for i in range(200)], "u string")
    orders = {
        tuple(sorted(map(tuple, shuffled_positions(keys, "u", 2, 42, digits=d).collect())))
        for d in (1, 2, 4)
    }
    assert len(orders) == 1
    counts = spark.createDataFrame([(float(i), i) for i in range(100)], "v double, n long")
    totals = {
        tuple(sorted(map(tuple, skew.running_totals(counts, "v", ["n"], ranges=r).collect())))
        for r in (2, 3, 50)
    }
    assert len(totals) == 1
    facts = spark.createDataFrame([("a" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i long")
    dims = facts.select("k").distinct().withColumn("d", F.length("k"))
    joined = {
        tuple(sorted(map(tuple, skew.spread_join(facts, dims, "k", ("i",), n).collect())))
        for n in (5, 40, 1000)
    }
    assert len(joined) == 1 and len(joined.pop()) == 300


def test_features_of_a_hot_customer(spark):
    """One customer owns a third of the events; the spread join counts them as a plain one does."""
    events = repeat.feature_events(inputs.customer_events(spark, SMALL), DRIVER_CONFIG)
    hot = events.withColumn(
        "user_pseudo_id",
        F.when(F.col("event_id") % 3 == 0, F.lit("u1_0")).otherwise(F.col("user_pseudo_id")),
    )
    buyers = repeat.eligible_first_orders(hot, DRIVER_CONFIG)
    found = customers.point_in_time_features(buyers, hot)
    plain = (
        hot.join(buyers.select("user_pseudo_id", "first_order_timestamp"), "user_pseudo_id")
        .where("event_timestamp <= first_order_timestamp")
        .groupBy("user_pseudo_id")
        .agg(
            F.count_distinct("ga_session_id").alias("sessions_before_first_purchase"),
            F.count_if(F.col("event_name") == "view_item").alias("product_views_before_purchase"),
        )
    )
    columns = plain.columns
    assert found.select(*columns).exceptAll(plain).count() == 0
    assert found.count() == plain.count() > 0


def test_only_days_up_to_the_last_first_order_are_read(spark, capsys):
    events = repeat.feature_events(inputs.customer_events(spark, SMALL), DRIVER_CONFIG)
    buyers = repeat.eligible_first_orders(events, DRIVER_CONFIG)
    customers.point_in_time_features(buyers, events).explain("formatted")
    plan = capsys.readouterr().out
    assert "LessThanOrEqual(event_timestamp," in plan
    assert "(event_date" in plan.split("PartitionFilters: ")[1].split("\n")[0]
    tree = plan[: plan.index("(1) Scan parquet")]
    # The events once; first orders and hot keys, small, where they are joined.
    assert tree.count("Scan parquet") <= 6


def test_staged_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_folder", lambda _: str(tmp_path))
    stored = staging.stage(spark.range(5).toDF("i"), "numbers")
    assert stored.count() == 5
    assert staging.remove_staged(spark)
    assert not (tmp_path / spark.sparkContext.applicationId).exists()
