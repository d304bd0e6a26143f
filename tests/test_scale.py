"""Operators that cut up hot keys and global orders give the plain result."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.ml.importance import shuffled_positions
from cartwright.ml.split import stratified_split
from cartwright.ml.stats import exact_medians, most_frequent
from cartwright.functions.columns import exact_sum
from cartwright.ml import evaluate
from cartwright.operators.cohorts import weighted_rate
from cartwright.operators.shares import mix_rate_decomposition, with_share
from cartwright.operators.skew import hot_keys, numbered, running_totals, spread_join
from cartwright.sources import staging
from cartwright.sources.driver_events import canonical_events
from cartwright.sources.tables import (
    load_days,
    read_events,
    read_shards,
    write_events,
    write_shards,
)
from cartwright.plans import segments
from cartwright.config import DRIVER_CONFIG


@pytest.fixture(scope="module")
def skewed(spark):
    """One of 50 keys owns a third of the rows."""
    rows = spark.range(9_000)
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50)
    return rows.withColumn("key", key.cast("long")).withColumn("n", F.col("id") % 17)


def test_hot_keys_are_found_and_bounded(skewed):
    hot = hot_keys(skewed, "key", rows_per_part=500).collect()
    assert [(r["key"], r["parts"]) for r in hot] == [(0, 7)]
    # With room for one key, only a key above all rows would pass.
    assert hot_keys(skewed, "key", rows_per_part=1, max_keys=1).count() == 0


def test_spread_join_equals_plain_join(spark, skewed):
    dims = spark.range(40).select(F.col("id").alias("key"), (F.col("id") * 2).alias("d"))
    spread = spread_join(skewed, dims, "key", ("id",), rows_per_part=500)
    plain = skewed.join(dims, "key")
    assert spread.columns == plain.columns
    assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_one_window(spark, skewed, descending):
    values = skewed.groupBy("key", F.col("id").alias("value")).agg(F.sum("n").alias("n"))
    got = running_totals(values, "value", ["n"], by=("key",), descending=descending, ranges=20)
    order = F.desc("value") if descending else F.asc("value")
    window = W.partitionBy("key").orderBy(order)
    want = values.withColumn("cum_n", F.sum("n").over(window))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_running_totals_without_groups_and_with_one_value(spark):
    one = spark.createDataFrame([(1.0, 4)], "value double, n long")
    assert running_totals(one, "value", ["n"]).first().cum_n == 4
    assert running_totals(one.where("n > 9"), "value", ["n"]).count() == 0


def test_medians_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {"odd": rng.integers(0, 9, 101), "even": rng.normal(size=500), "one": [3.5]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("odd", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = dict(exact_medians(df, "g").collect())
    assert got == {g: float(np.median(vs)) for g, vs in groups.items()}


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame(
        [("f", "b"), ("f", "a"), ("f", "b"), ("f", "a"), ("f", None), ("f", None), ("f", None)],
        "g string, value string",
    )
    assert most_frequent(df, "g").first()["mode"] == "a"


@pytest.mark.parametrize("ones,zeros", [(13, 87), (1, 4), (250, 757), (3, 0)])
def test_split_counts_are_exact(spark, ones, zeros):
    rows = [(f"u{i}", int(i < ones)) for i in range(ones + zeros)]
    df = spark.createDataFrame(rows, "u string, y int")
    split = stratified_split(df, "y", "u").collect()
    assert len(split) == ones + zeros
    test = [r for r in split if r.split == "test"]
    total = ones + zeros
    assert len(test) == -(-total // 5)
    assert abs(sum(r.y for r in test) - ones / 5) < 1


def test_split_depends_on_seed_only(spark):
    df = spark.createDataFrame([(f"u{i}", i % 2) for i in range(200)], "u string, y int")
    first = {r.u for r in stratified_split(df, "y", "u").where("split = 'test'").collect()}
    again = stratified_split(df.repartition(7), "y", "u").where("split = 'test'").collect()
    other = stratified_split(df, "y", "u", seed=7).where("split = 'test'").collect()
    assert first == {r.u for r in again} != {r.u for r in other}


def test_positions_are_permutations(spark):
    keys = spark.createDataFrame([(f"u{i}",) for i in range(333)], "u string")
    rows = shuffled_positions(keys, "u", repeats=3, seed=42, digits=1).collect()
    orders = [
        [r.u for r in sorted((r for r in rows if r.repeat == k), key=lambda r: r.position)]
        for k in range(4)
    ]
    for order in orders:
        assert sorted(order) == sorted(f"u{i}" for i in range(333))
    assert len({tuple(o) for o in orders}) == 4


def test_one_user_with_a_third_of_the_events(spark, tmp_path):
    """Sessions of a hot user equal those from one window over all events."""
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    hot = source.withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id"))
    )
    hot.write.parquet(f"{tmp_path}/events.parquet")
    events = canonical_events(spark, str(tmp_path), split=1, gap_hours=12)
    sessions = (
        events.where("event_id < 1000000000 and event_name != 'session_start'")
        .where(F.col("event_id") % 50 != 7)
        .select(
            "event_id",
            F.element_at("event_params", -1)["value"]["int_value"].alias("session"),
        )
    )
    by_user = W.partitionBy("user_id").orderBy("us", "event_id")
    base = hot.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    gap = F.col("us") - F.lag("us").over(by_user)
    opened = F.when(gap.isNull() | (gap > 12 * 3_600_000_000), F.col("us"))
    want = (
        base.withColumn("opened", opened)
        .withColumn("session", F.last("opened", True).over(by_user))
        .where(F.col("event_id") % 50 != 7)
        .select("event_id", F.expr("session div 1000000").alias("session"))
    )
    assert sessions.exceptAll(want).count() == 0 and sessions.count() == want.count()


def test_stored_events_are_pruned(spark, tmp_path, capsys):
    events = canonical_events(spark, "/root/testdata/sf0.001")
    path = f"{tmp_path}/stored"
    write_events(events, path)
    month = DRIVER_CONFIG.audit_month
    stored = read_events(spark, path, month.start, month.end)
    report = segments.funnel_device(stored, DRIVER_CONFIG)
    assert report.count() > 0
    report.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(event_date" in plan
    read = plan[plan.index("ReadSchema:") :].split("\n")[0]
    assert "int_value" in read and "string_value" not in read and "items" not in read


def test_days_are_added_and_replaced(spark, tmp_path):
    """Two days in two calls, one of them again with other events: each event once."""
    events = canonical_events(spark, "/root/testdata/sf0.001")
    days = [r[0] for r in events.select("event_date").distinct().orderBy("event_date").limit(3).collect()]
    dates = [datetime.strptime(d, "%Y%m%d").date() for d in days]
    shards, path = f"{tmp_path}/shards", f"{tmp_path}/store"
    write_shards(events, shards, [dates[0], dates[2]])  # the second day has no shard
    load_days(read_shards(spark, shards, dates[0], dates[0]), path)
    load_days(read_shards(spark, shards, dates[1], dates[2]), path)
    stored = read_events(spark, path)
    want = events.where(F.col("event_date").isin(days[0], days[2]))
    assert stored.select("event_id").exceptAll(want.select("event_id")).count() == 0
    assert stored.count() == want.count() == read_shards(spark, shards).count()

    fewer = events.where(F.col("event_date") == days[2]).limit(2)
    load_days(fewer, path)
    counts = dict(read_events(spark, path).groupBy("event_date").count().collect())
    assert counts == {days[0]: events.where(F.col("event_date") == days[0]).count(), days[2]: 2}
    with pytest.raises(Exception, match="no event_date"):
        load_days(fewer.withColumn("event_date", F.lit(None).cast("string")), path)


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "local[2]"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError):
        staging.shared_folder(Session())


def test_numbered_equals_one_window(spark):
    """200,000 categories, most of them of one feature, and values that sort as text."""
    values = spark.range(200_000).select(
        F.when(F.col("id") < 1000, F.lit("few")).otherwise(F.lit("many")).alias("feature"),
        F.concat(F.lit("v"), F.col("id") * 7919 % 200_000).alias("value"),
    )
    got = numbered(values, "feature", "value", "index", ranges=16)
    place = F.row_number().over(W.partitionBy("feature").orderBy("value")) - 1
    want = values.withColumn("index", place.cast("long"))
    both = got.withColumn("index", F.col("index").cast("long"))
    assert both.exceptAll(want).count() == 0 and got.count() == 200_000
    largest = got.groupBy("feature", F.col("index")).count().agg(F.max("count")).first()[0]
    assert largest == 1
    assert numbered(values.where("false"), "feature", "value", "index").count() == 0


def test_share_joined_back_equals_the_window(spark, skewed):
    rows = skewed.groupBy("key", "n").agg(F.count("*").alias("v")).withColumn(
        "key", F.when(F.col("key") != 7, F.col("key"))
    )
    got = with_share(rows, "v", "key", "pct")
    total = F.sum("v").over(W.partitionBy("key"))
    want = rows.withColumn("pct", F.round(100 * F.col("v") / total, 2))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def in_many_orders(spark, rows, result):
    """The result of the rows dealt out in several ways."""
    found = set()
    for parts, column in ((1, "id"), (3, "id"), (7, "half"), (5, "id")):
        dealt = rows.withColumn("half", F.col("id") % 2).repartition(parts, column)
        dealt = dealt.sortWithinPartitions(F.desc("id") if parts % 2 else "id").drop("half")
        found.add(tuple(tuple(r) for r in result(dealt).collect()))
    return found


def test_sums_of_ratios_are_the_same_in_every_partitioning(spark):
    ids = spark.range(4_000)
    noise = F.pmod(F.xxhash64("id"), F.lit(10_007)) / 10_007.0
    terms = ids.withColumn("x", noise / 3)
    assert len(in_many_orders(spark, terms, lambda df: df.agg(exact_sum(F.col("x"))))) == 1

    scored = ids.select("id", (noise < 0.3).cast("int").alias("label"), noise.alias("score"))
    for measure in (evaluate.average_precision, evaluate.roc_auc):
        found = in_many_orders(spark, scored, lambda df: measure(evaluate.score_curve(df)))
        assert len(found) == 1

    mixes = ids.select(
        "id",
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("period"),
        F.floor(F.col("id") / 2).alias("segment"),
        (F.col("id") % 13 + 1).alias("weight"),
        noise.alias("rate"),
    )
    names = {"same": (0, 0), "crossed": (0, 1)}
    found = in_many_orders(
        spark,
        mixes,
        lambda df: mix_rate_decomposition(df, ("a", "b"), "segment", "weight", "rate", names, digits=15),
    )
    assert len(found) == 1

    cohorts = ids.select(
        "id",
        (F.col("id") % 97 + 1).alias("cohort_size"),
        noise.alias("week_1_rate"),
        F.lit(True).alias("eligible_week_1"),
    )
    assert len(in_many_orders(spark, cohorts, lambda df: df.agg(weighted_rate(1)))) == 1
