"""Physical plans keep the shape the reports were written for."""

import pytest

from cartwright.config import DRIVER_CONFIG
from cartwright.operators.orders import leading_orders
from cartwright.operators.skew import numbered
from cartwright.plans import audit, kpi, repeat, retention, segments
from registry import inputs

SF = "/root/testdata/sf0.001"
MODULES = (audit, kpi, segments, retention)
# Reports that store their counts before totals are joined back are seen by those counts.
COUNTS = {"channel_funnel": segments.channel_counts, "channel_mix": segments.channel_starts}
REPORTS = {name: f for m in MODULES for name, f in m.REPORTS.items()} | COUNTS
# Reports that join two aggregates of the events.
TWO_SCANS = {"kpi_daily_funnel_orders", "kpi_period_summary", "dq_placeholder_patterns"}


@pytest.fixture
def plan(capsys):
    def text(df):
        capsys.readouterr()
        df.explain("formatted")
        return capsys.readouterr().out

    return text


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_scans_once_without_pairing_rows(spark, plan, name):
    text = plan(REPORTS[name](inputs.events(spark, SF), DRIVER_CONFIG))
    tree = text[: text.index("(1) ")]
    assert "Cartesian" not in text and "NestedLoop" not in text
    if name not in TWO_SCANS:
        assert tree.count("Scan parquet") == 1
    assert "string_value" not in text
    if name != "dq_event_inventory":
        assert "PushedFilters: [" in text and "event_name" in text


@pytest.mark.parametrize(
    "name", ["dq_month_daily_coverage", "kpi_monthly_orders", "kpi_period_summary", "channel_mix"]
)
def test_day_bounds_prune_folders(spark, plan, name):
    text = plan(REPORTS[name](inputs.events(spark, SF), DRIVER_CONFIG))
    assert "PartitionFilters: [isnotnull(event_date" in text


@pytest.mark.parametrize(
    "name", ["kpi_initial_funnel", "kpi_validated_funnel", "dq_composite_order_grain"]
)
def test_flag_reports_use_hash_aggregates_without_expansion(spark, plan, name):
    text = plan(REPORTS[name](inputs.events(spark, SF), DRIVER_CONFIG))
    assert "SortAggregate" not in text and "Expand" not in text


def test_first_orders_are_limited_before_the_shuffle(spark, plan):
    orders = repeat.orders_in_window(inputs.events(spark, SF), DRIVER_CONFIG, "session")
    text = plan(leading_orders(orders))
    assert text[: text.index("(1) ")].count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_channel_shares_need_no_window(spark, plan, name):
    report = segments.REPORTS[name](inputs.events(spark, SF), DRIVER_CONFIG)
    text = plan(report)
    assert "Window" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert "partial_sum(sessions" in text


def test_no_window_numbers_a_whole_feature(spark, plan):
    encoding = inputs.model(spark, SF, "logistic").encoding
    assert "Window" not in plan(encoding.dictionary)
    values = spark.range(1000).selectExpr("id % 3 AS feature", "cast(id AS string) AS value")
    text = plan(numbered(values.distinct(), "feature", "value", "index"))
    assert "row_number() windowspecdefinition(feature" in text
    assert "windowspecdefinition(feature#" in text and "value_range#" in text
