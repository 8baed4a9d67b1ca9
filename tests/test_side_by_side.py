"""Feeds that don't wait for each other load side by side."""

import threading
from datetime import datetime

from faultline.operators import core as core_ops
from faultline.plans import batch
from faultline.session import side_by_side
from faultline.sources.warehouse import Warehouse
from tests.test_incremental import feed, incident, known, order, record  # noqa: F401


def test_results_keep_their_order_and_errors_are_raised():
    meet = threading.Barrier(3, timeout=30)
    assert side_by_side(lambda i: (meet.wait(), i)[1], [3, 1, 2]) == [3, 1, 2]
    assert side_by_side(str, []) == []
    try:
        side_by_side(lambda i: 1 // i, [1, 0])
    except ZeroDivisionError:
        return
    raise AssertionError("an error was lost")


def test_feeds_wait_for_incidents_alone(spark, tmp_path, known, monkeypatch):  # noqa: F811
    meet, accept, seen = threading.Barrier(2, timeout=120), core_ops.accepted_payloads, []

    def watched(name, *rest):
        seen.append(name)
        if name != "incidents":
            meet.wait()
        return accept(name, *rest)

    monkeypatch.setattr(core_ops, "accepted_payloads", watched)
    house = Warehouse(spark, str(tmp_path), buckets=4)
    rows = {
        "incidents": [incident(1)], "work_orders": [order(1, 1), order(2, 5)],
        "events": [record("events", "E1", incident_id="I1"), record("events", "E2", incident_id="I9")],
    }
    batch.load_raw(house, {name: feed(spark, r) for name, r in rows.items()}, "RUN-1")
    batch.load_payloads(house, "RUN-1", datetime(2030, 1, 1), known)
    assert seen[0] == "incidents" and sorted(seen) == ["events", "incidents", "work_orders"]
    assert [r.event_id for r in house.core("events").collect()] == ["E1"]
    assert [r.work_order_id for r in house.core("work_orders").collect()] == ["W1"]
    assert house.observed["waiting", "events"]["rows"] == house.observed["waiting", "work_orders"]["rows"] == 1
