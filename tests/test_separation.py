"""The driver data tell the rules apart: a statement with another rule gives other rows."""

import pytest

from check_oracles import compare, duck
from registry.oracles import WINDOW
from registry.queries import all_queries
from registry.statements import all_statements

FOLDER = "/root/testdata/sf0.01"

# Query, a part of its statement, and what another rule would say there.
MUTATIONS = {
    "order day in UTC, not the export's day": (
        "kpi_daily_orders",
        "cast(make_timestamp(ots) AS DATE)",
        "oday",
    ),
    "export day, not the UTC day": ("kpi_daily_funnel_orders", "us - 28800000000", "us"),
    "first item, not the last": ("product_family", "cats[1] AS cat", "cats[-1] AS cat"),
    "every item, not the first": (
        "product_category_inventory",
        "unnest(cats) AS cat",
        "cat",
    ),
    "users that are known": ("user_day_activity", "AND uid IS NOT NULL", ""),
    "session keys that are known": ("funnel_device", "uid IS NOT NULL AND sid IS NOT NULL", "true"),
    "channel of the session start, not of the last event": (
        "channel_funnel",
        "arg_min(src, (us, event_id)) FILTER (nm = 'session_start' AND src IS NOT NULL)",
        "arg_max(src, (us, event_id)) FILTER (src IS NOT NULL)",
    ),
    "without the partial cohort": ("retention_matrix", "WHERE cw > DATE '2023-12-25'", ""),
    "without the partial cohort, by month": (
        "retention_monthly_weighted",
        "WHERE cw > DATE '2023-12-25'",
        "",
    ),
    "orders of the window": ("lifecycle_segments", WINDOW, "true"),
    "events of the feature window": ("point_in_time_features", f"e.{WINDOW}", "true"),
    "days of the periods": ("kpi_period_summary", f"WHERE {WINDOW}", ""),
}


@pytest.mark.parametrize("rule", MUTATIONS)
def test_another_rule_gives_other_rows(spark, rule):
    name, part, other = MUTATIONS[rule]
    statement = all_statements()[name]
    assert part in statement
    frame = all_queries()[name](spark, FOLDER)
    rows = frame.collect()
    assert compare(frame, rows, duck(FOLDER), statement) == ""
    assert compare(frame, rows, duck(FOLDER), statement.replace(part, other)) != ""
