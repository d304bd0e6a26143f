"""Small nested events for the rules on which the reports differ."""

from datetime import date


import pytest

from cartwright.config import DRIVER_CONFIG, FUNNEL_APPAREL_PATTERN, CommerceConfig, Period
from cartwright.functions.columns import (
    event_param,
    family_patterns,
    label_rank,
    pct,
    product_family,
)
from cartwright.operators import cohorts, customers, orders, sessions, shape, shares
from cartwright.plans import audit, kpi, repeat, retention, segments
from registry import inputs
from tests.conftest import event

DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01 00:00 UTC


def shaped(make_events, rows):
    return shape.shape_events(make_events(rows))


def test_parameter_lookup(spark, make_events):
    twice = [
        {"key": "ga_session_id", "value": {"string_value": None, "int_value": 1}},
        {"key": "ga_session_id", "value": {"string_value": None, "int_value": 2}},
    ]
    rows = [
        event("purchase", "a", 7, START, 1),
        event("purchase", "a", None, START, 2),
        event("purchase", "a", None, START, 3, override={"event_params": None}),
        event("purchase", "a", None, START, 4, override={"event_params": []}),
        event("purchase", "a", None, START, 5, override={"event_params": twice}),
    ]
    found = make_events(rows).select("event_id", event_param("ga_session_id").alias("sid"))
    assert dict(found.collect()) == {1: 7, 2: None, 3: None, 4: None, 5: 1}


def test_items(make_events):
    rows = [
        event("view_item", "a", 1, START, 1, items=[{"item_category": "Bags"}, {"item_category": "Sale"}]),
        event("view_item", "a", 1, START, 2, items=[]),
        event("view_item", "a", 1, START, 3, override={"items": None}),
        event("purchase", "a", 1, START, 4, items=[{"item_category": "Bags"}]),
    ]
    flat = shaped(make_events, rows)
    assert dict(flat.select("event_id", "item_category").collect()) == {
        1: "Bags", 2: None, 3: None, 4: None,
    }
    exploded = shape.explode_items(flat).select("event_id", "item_category").collect()
    assert sorted(map(tuple, exploded)) == [(1, "Bags"), (1, "Sale"), (4, "Bags")]


def test_first_attribute_skips_nulls_and_other_events(make_events):
    rows = [
        event("view_item", "a", 1, START, 1, device="tablet"),
        event("session_start", "a", 1, START + 1, 2),
        event("session_start", "a", 1, START + 2, 4, device="mobile"),
        event("session_start", "a", 1, START + 2, 3, device="desktop"),
    ]
    config = CommerceConfig(periods=(Period("P", date(2024, 1, 1), date(2024, 1, 31)),))
    row = segments.funnel_device(make_events(rows), config).collect()
    assert [(r.device_category, r.sessions) for r in row] == [("desktop", 1)]


def test_session_across_midnight(make_events):
    rows = [
        event("session_start", "a", 1, START + DAY - 1, 1, date="20240101"),
        event("view_item", "a", 1, START + DAY, 2, date="20240102"),
    ]
    flat = shaped(make_events, rows)
    steps = ("session_start", "view_item")
    assert sessions.session_flags(flat, steps).count() == 1
    assert sessions.session_daily_flags(flat, steps).count() == 2


def test_sessions_need_both_keys(make_events):
    rows = [
        event("session_start", "a", None, START, 1),
        event("session_start", None, 1, START, 2),
        event("session_start", "a", 1, START, 3),
    ]
    assert sessions.session_flags(shaped(make_events, rows), ("session_start",)).count() == 1
    coverage = audit.dq_session_id_coverage(make_events(rows), CommerceConfig()).first()
    assert (coverage.event_count, coverage.missing_session_id, coverage.sessions) == (3, 1, 1)


def test_transaction_rules(make_events):
    ids = {1: None, 2: "", 3: "(not set)", 4: "T1"}
    rows = [event("purchase", "a", 1, START, i, txn=t) for i, t in ids.items()]
    bought = shape.purchase_rows(shaped(make_events, rows))
    kept = {
        rule: {r.event_id for r in shape.valid_purchases(bought, rule).collect()}
        for rule in ("strict", "nonblank")
    }
    assert kept == {"strict": {4}, "nonblank": {3, 4}}
    assert {r.event_id for r in shape.placeholder_purchases(bought).collect()} == {1, 2, 3}


def order_rows():
    return [
        event("purchase", "a", 1, START + 5, 2, txn="T1", revenue=20.0, quantity=2),
        event("purchase", "a", 1, START + 5, 1, txn="T1", revenue=None, quantity=1),
        event("purchase", "a", 1, START + DAY, 3, txn="T1", revenue=5.0, date="20240102"),
        event("purchase", "a", 2, START + 2 * DAY, 4, txn="T1", revenue=7.0, date="20240103"),
    ]


def test_order_grains_and_pinned_values(make_events):
    valid = shape.valid_purchases(shape.purchase_rows(shaped(make_events, order_rows())))
    counts = {g: orders.clean_orders(valid, g).count() for g in orders.GRAINS}
    assert counts == {"session": 2, "day_session": 3, "user": 1}
    first = orders.clean_orders(valid, "user").first()
    # The earliest event has the smaller id; its missing revenue stays missing.
    assert (first.order_revenue, first.item_quantity) == (None, 1)


def test_version_checks_ignore_nulls(make_events):
    rows = order_rows()[:2] + [event("purchase", "b", 3, START, 9, txn="T2", revenue=1.0)]
    quality = audit.dq_clean_order_quality(make_events(rows), CommerceConfig()).first()
    assert (quality.orders, quality.revenue_mismatch_orders) == (2, 0)
    assert (quality.quantity_mismatch_orders, quality.orders_with_null_revenue) == (1, 1)


def test_ranks_break_ties_and_span_hours(spark):
    rows = [("a", 1, "T2", START), ("a", 2, "T1", START), ("a", 1, "T1", START)]
    rows += [("a", 1, f"T{i}", START + i * 3_600_000_000) for i in range(3, 8)]
    bought = spark.createDataFrame(
        rows, "user_pseudo_id string, ga_session_id long, transaction_id string, order_timestamp long"
    )
    ranked = orders.ranked_orders(bought).orderBy("purchase_number").collect()
    assert [r.purchase_number for r in ranked] == list(range(1, 9))
    assert [(r.transaction_id, r.ga_session_id) for r in ranked[:3]] == [
        ("T1", 1), ("T1", 2), ("T2", 1),
    ]
    assert orders.leading_orders(bought).count() == 2


def test_first_purchase_by_rank_or_by_day(spark):
    rows = [
        ("a", "T1", START, date(2024, 1, 2)),
        ("a", "T2", START + 1, date(2024, 1, 1)),
    ]
    bought = spark.createDataFrame(
        rows, "user_pseudo_id string, transaction_id string, order_timestamp long, order_date date"
    )
    days = {
        rule: orders.first_second_purchase(bought, rule).first().first_purchase_date
        for rule in ("rank", "min")
    }
    assert days == {"rank": date(2024, 1, 2), "min": date(2024, 1, 1)}


def test_repeat_label_is_strict_and_bounded(spark):
    limit = 30 * DAY
    rows = [("same", 0, 0), ("edge", 0, limit), ("late", 0, limit + 1), ("none", 0, None)]
    found = spark.createDataFrame(
        rows, "user_pseudo_id string, first_order_timestamp long, next_order_timestamp long"
    ).select("user_pseudo_id", customers.repeat_label(30).alias("y"))
    assert dict(found.collect()) == {"same": 1, "edge": 1, "late": 0, "none": 0}
    same_time = spark.createDataFrame(
        [("a", 1, "T1", START), ("a", 2, "T2", START), ("a", 2, "T3", START + 9)],
        "user_pseudo_id string, ga_session_id long, transaction_id string, order_timestamp long",
    )
    first = customers.first_orders(same_time).first()
    assert (first.transaction_id, first.next_order_timestamp) == ("T1", START + 9)


def test_family_patterns(spark):
    names = ["Men's / Unisex", " ", "(Not Set)", None, "New Bags", "Office"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    rows = df.select(
        "c",
        product_family("c"),
        product_family("c", family_patterns(FUNNEL_APPAREL_PATTERN)),
    ).collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("Apparel", "Other"),
        ("(not set)", "(not set)"),
        ("(not set)", "(not set)"),
        ("(not set)", "(not set)"),
        ("Bags", "Bags"),
        ("Other", "Other"),
    ]


def test_percent_rounds_half_up_and_survives_zero(spark):
    df = spark.createDataFrame([(1, 800), (1, 0), (0, 4)], "a long, b long")
    assert [r[0] for r in df.select(pct("a", "b")).collect()] == [0.13, None, 0.0]


def test_label_rank_of_unlisted_label_is_null(spark):
    df = spark.createDataFrame([("b",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(label_rank("v", ["a", "b"])).collect()] == [2, None, None]


def test_decomposition_drops_one_sided_segments(spark):
    rows = [("A", "x", 30, 0.5), ("A", "y", 70, 0.1), ("B", "x", 10, 0.4), ("B", "z", 90, 0.9)]
    df = spark.createDataFrame(rows, "period string, seg string, w long, r double")
    names = {"aa": (0, 0), "bb": (1, 1), "ab": (0, 1), "ba": (1, 0)}
    row = shares.mix_rate_decomposition(df, ("A", "B"), "seg", "w", "r", names).first()
    assert (row.aa, row.bb, row.ab, row.ba) == (15.0, 4.0, 12.0, 5.0)


def retention_rows():
    week = 7 * DAY
    return [
        event("first_visit", "a", 1, START + 2 * DAY, 1, date="20240103"),
        event("session_start", "a", 1, START + DAY, 2, date="20240102"),
        event("session_start", "b", 2, START, 3, date="20240101"),
        event("first_visit", "b", 2, START, 4, date="20240101"),
        event("session_start", "b", 3, START + 2 * week, 5, date="20240115"),
        event("session_start", "c", 4, START + 2 * week + DAY, 6, date="20240116"),
    ]


def test_retention_floors_and_unobservable_weeks(make_events):
    activity = cohorts.user_day_activity(shaped(make_events, retention_rows()))
    active = {
        floor: cohorts.weeks_since(cohorts.user_weeks(activity, floor)).count()
        for floor in ("visit", "cohort")
    }
    # User a was only active before the first visit, but after the Monday.
    assert active == {"visit": 2, "cohort": 3}
    config = CommerceConfig(partial_cohort_until=None)
    row = retention.retention_matrix(make_events(retention_rows()), config).first()
    assert row.cohort_size == 2
    assert [row.week_0, row.week_1, row.week_2, row.week_3] == [100.0, 0.0, 50.0, None]
    later = CommerceConfig(partial_cohort_until=date(2024, 1, 1))
    assert retention.retention_matrix(make_events(retention_rows()), later).count() == 0


FEATURE_CONFIG = CommerceConfig(
    feature_events_from=date(2024, 1, 1),
    orders_from=date(2024, 1, 1),
    orders_until=date(2024, 3, 31),
    eligible_from=date(2024, 1, 1),
    eligible_until=date(2024, 2, 15),
)


def shopping():
    return [
        event("first_visit", "a", 1, START, 1),
        event("view_item", "a", 1, START + 1, 2),
        event("view_item", "a", None, START + 2, 3),
        event(
            "purchase", "a", 2, START + DAY, 4, txn="T1", revenue=10.0, quantity=1,
            device="mobile", date="20240102",
        ),
    ]


def later_events():
    return [
        event("view_item", "a", 3, START + DAY + 1, 5, date="20240102"),
        event("add_to_cart", "a", 3, START + 2 * DAY, 6, date="20240103"),
        event("view_search_results", "a", 4, START + 3 * DAY, 7, date="20240104"),
    ]


def test_features_ignore_everything_after_the_first_order(make_events):
    before = repeat.ml_feature_table(make_events(shopping()), FEATURE_CONFIG).collect()
    after = repeat.ml_feature_table(
        make_events(shopping() + later_events()), FEATURE_CONFIG
    ).collect()
    assert before == after
    row = before[0]
    assert row.sessions_before_first_purchase == 2
    assert row.product_views_before_purchase == 2
    assert row.days_first_visit_to_purchase == 1
    assert (row.purchase_day_of_week, row.purchase_hour_utc) == (3, 0)
    assert (row.first_source, row.repeat_purchase_30d) == ("(unknown)", 0)


def test_days_without_first_visit_stay_null(make_events):
    row = repeat.ml_feature_table(make_events(shopping()[1:]), FEATURE_CONFIG).first()
    assert row.days_first_visit_to_purchase is None


def test_reference_column_names(make_events):
    row = segments.customer_conversion_decomposition(make_events(shopping()), CommerceConfig())
    assert row.columns == [
        "actual_december_conversion_pct",
        "actual_january_conversion_pct",
        "jan_conversion_with_december_mix_pct",
        "jan_conversion_with_december_behavior_pct",
    ]
    segments_30 = repeat.lifecycle_segments(make_events(shopping()), CommerceConfig())
    assert "total_segment_revenue_30d" in segments_30.columns


@pytest.mark.parametrize(
    "name", [n for m in (audit, kpi, segments) for n in m.SESSION_REPORTS]
)
def test_stored_sessions_give_the_same_report(spark, name):
    events = inputs.events(spark, "/root/testdata/sf0.001")
    function = {**audit.REPORTS, **kpi.REPORTS, **segments.REPORTS}[name]
    table = sessions.session_table(shape.shape_events(events))
    direct = function(events, DRIVER_CONFIG).collect()
    assert direct == function(None, DRIVER_CONFIG, sessions=table).collect()
    assert direct


def test_whole_and_shares(spark):
    df = spark.createDataFrame([("p", 1), ("p", 2), ("q", 5)], "g string, n long")
    rows = df.select("g", shares.share_of_total("n", ["g"]), shares.share_of_grand_total("n"))
    by = [tuple(r) for r in rows.collect()]
    assert by == [("p", 33.33, 12.5), ("p", 66.67, 25.0), ("q", 100.0, 62.5)]
