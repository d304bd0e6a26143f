import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cartwright.session import local_session  # noqa: E402
from cartwright.sources.schema import EVENTS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "cartwright-tests")
    # On these tiny tables compiling the plans costs more than running them;
    # check_oracles.py runs the compiled plans.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def event(name, user, session, micros, eid, **values):
    """One nested event; ``session=None`` leaves the session parameter out."""
    params = [{"key": "page", "value": {"string_value": "/", "int_value": None}}]
    if session is not None:
        params.append(
            {"key": "ga_session_id", "value": {"string_value": None, "int_value": session}}
        )
    row = {
        "event_timestamp": micros,
        "event_id": eid,
        "event_name": name,
        "user_pseudo_id": user,
        "event_params": params,
        "device": {"category": values.get("device")},
        "traffic_source": {"source": values.get("source"), "medium": values.get("medium")},
        "ecommerce": {
            "transaction_id": values.get("txn"),
            "purchase_revenue": values.get("revenue"),
            "total_item_quantity": values.get("quantity"),
        },
        "items": values.get("items", []),
        "event_date": values.get("date", "20240101"),
    }
    row.update(values.get("override", {}))
    return row


@pytest.fixture
def make_events(spark):
    return lambda rows: spark.createDataFrame(rows, EVENTS)
