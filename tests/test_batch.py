"""End-to-end goldens of the hand-made incidents."""

import json
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline.plans.batch import run_batch
from faultline.sources.warehouse import Warehouse


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_run_counts(batch):
    row, _ = batch
    assert row["status"] == "PARTIAL_SUCCESS"
    # 7 incident, 35 event, 3 order, 2 validation, 1 alert records; the repeated one is rejected
    assert (row["rows_extracted"], row["rows_loaded"], row["rows_rejected"]) == (48, 47, 1)
    assert row["quality_failed_checks"] == 6
    # 5 + 35 + 3 + 2 + 1 of the feeds, 2 + 3 + 2 + 1 + 2 masters, 2 snapshots; the partial incident is skipped
    assert (row["core_records_loaded"], row["core_records_skipped"]) == (58, 1)
    assert row["reconciliation_issues_created"] == 7


def test_core_and_analytics_counts(batch, core):
    assert {name: df.count() for name, df in core.items()} == {
        "zones": 2, "assets": 3, "dependencies": 2, "engineers": 1, "spares": 2, "incidents": 5, "events": 35,
        "work_orders": 3, "validations": 2, "alerts": 1, "snapshots": 2,
    }
    house = batch[1]
    # lead times: 7 stages of P1 less the terminal one, 4 of P2, 2 of P3, 5 of P4, and P1's end
    sizes = {
        "current_status": 4, "stage_lead_times": 18, "follow_up_queue": 3, "asset_delay_summary": 3, "zone_delay_summary": 2,
        "spare_waiting_summary": 1,
    }
    assert {name: house.snapshot("analytics", name).count() for name in sizes} == sizes
    assert house.run_parts("ops/checks").count() == 41


def test_failed_checks(batch):
    failed = batch[1].run_parts("ops/checks").where("status <> 'PASS'")
    assert {(t, c): tuple(k) for t, c, k in rows(failed, "target_table", "check_name", "sample_failed_keys")
            if t != "raw_infrastructure_incidents"} == {
        ("infrastructure_incidents", "infrastructure_incident_without_stage_event"): ("P5",),
        ("incident_stage_events", "stage_event_timestamp_out_of_order"): ("f0",),
        ("facility_work_orders", "spare_waiting_without_required_spare"): ("W4",),
        ("validation_results", "validation_without_completed_work"): ("V3",),
    }
    raw = failed.where("target_table = 'raw_infrastructure_incidents'")
    assert {c: (n, k[0].split(":")[1].split(" ")[0]) for c, n, k in rows(raw, "check_name", "failed_row_count", "sample_failed_keys")} == {
        "duplicate_source_record": (1, "i-P1"), "missing_required_fields": (1, "i-partial"),
    }


def test_queue(batch):
    queue = batch[1].snapshot("analytics", "follow_up_queue").orderBy("priority_rank")
    assert rows(queue, "priority_rank", "incident_id", "total_priority_score") == [(1, "P2", 208.96), (2, "P4", 84.0), (3, "P3", 58.13)]
    scores = [
        "asset_criticality_score", "downtime_score", "stage_delay_score", "infrastructure_zone_impact_score",
        "needed_by_urgency_score", "repeat_failure_score", "spare_risk_score", "capacity_risk_score",
        "redundancy_risk_score", "thermal_risk_score", "vendor_eta_risk_score", "mitigation_credit_score",
    ]
    first, second, third = queue.collect()
    # 20 h x 1.2; 73 h late / 3; needed long ago; out of stock and critical; 100 / 10 + 262.5 / 100 = 12.625, tie to even
    assert [first[c] for c in scores] == [35.0, 24.0, 24.33, 16.0, 24.0, 0.0, 22.0, 12.62, 24.0, 5.0, 22.0, 0.0]
    # pump 1 has two incidents; a waiting order without spare
    assert [second[c] for c in scores] == [5.0, 12.0, 9.0, 16.0, 24.0, 8.0, 14.0, 0.0, 0.0, 0.0, 0.0, 4.0]
    assert [third[c] for c in scores] == [12.0, 4.8, 5.33, 4.0, 24.0, 8.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert first.recommended_action == "Escalate missed vendor ETA and confirm recovery path"
    assert first.reason_summary == (
        "CRITICAL asset in WEST side is delayed in SPARE_VENDOR_WAITING for 91.0 hours. Impact rationale: 100 affected "
        "GPUs and 262 kW at risk; N-1 redundancy exposure; 30 thermal breach minutes; vendor status ETA_MISSED."
    )


def test_stage_totals(batch):
    stages = batch[1].snapshot("analytics", "bottleneck_summary").where("dimension_type = 'STAGE'")
    found = {r[0]: r[1:] for r in rows(
        stages, "stage", "request_count", "delayed_count", "total_delay_hours", "avg_duration_hours",
        "p90_duration_hours")}
    assert found == {
        "INCIDENT_REPORTED": (4, 0, 0.0, 0.88, 1.0),  # 0.5, 1, 1, 1: 0.875
        "FACILITIES_TRIAGE": (4, 1, 16.0, 6.75, 24.0),  # 0.5, 0.5, 24, 2
        "ENGINEER_ASSIGNED": (3, 0, 0.0, 0.67, 1.0),  # 0.5, 0.5, 1
        "SPARE_VENDOR_WAITING": (3, 1, 73.0, 31.17, 91.0),  # 0.5, 91, 2
        "REPAIR_IN_PROGRESS": (2, 1, 27.0, 26.0, 51.0),  # 1, 51
        "VALIDATION": (1, 0, 0.0, 1.0, 1.0),
    }


def test_delay_summaries(batch):
    house = batch[1]
    assets = house.snapshot("analytics", "asset_delay_summary")
    # downtime and delay: 4 + 10 + 27; 20 + 73; 4 + 16
    assert {r[0]: r[1] for r in rows(assets, "asset_id", "total_downtime_hours")} == {"PUMP-1": 41, "PUMP-2": 93, "VALVE": 20}
    pump = assets.where("asset_id = 'PUMP-1'").first()
    assert (pump.request_count, pump.repeat_failure_count, pump.top_failure_mode) == (2, 2, "LEAK")
    zones = house.snapshot("analytics", "zone_delay_summary")
    assert {r[0]: r[1] for r in rows(zones, "zone_id", "total_downtime_hours")} == {"WEST": 134, "EAST": 20}
    spare = house.snapshot("analytics", "spare_waiting_summary").first()
    assert (spare.spare_name, spare.total_wait_hours, spare.waiting_request_count) == ("ROTOR", 91.0, 1)


def test_issues(batch):
    issues = batch[1].run_parts("ops/issues")
    assert [r[:2] for r in sorted(rows(issues, "incident_id", "issue_type", "issue_id"), key=lambda r: r[2])] == [
        ("P2", "impact_thermal_context_missing_evidence"),
        ("P3", "validation_without_completed_work"),
        ("P4", "event_sequence_before_request"),
        ("P4", "impact_mitigation_without_event_evidence"),
        ("P4", "spare_waiting_missing_required_spare"),
        ("P5", "analytics_output_missing_current_status"),
        ("P5", "state_reconstruction_missing_stage_event"),
    ]
    evidence = {(r[0], r[1]): json.loads(r[2]) for r in rows(issues, "incident_id", "issue_type", "evidence_json")}
    assert evidence["P4", "impact_mitigation_without_event_evidence"] == {
        "mitigation_status": "RUNNING_DEGRADED",
        "expected_event_type": "MITIGATION_APPLIED",
        "latest_snapshot_id": "S4",
        "latest_snapshot_at": "2030-03-03T00:00:00",
    }
    assert evidence["P4", "spare_waiting_missing_required_spare"] == {
        "work_order_count": 1,
        "first_work_order_id": "W4",
        "last_work_order_id": "W4",
        "work_order_status": "WAITING_SPARE_VENDOR",
    }
    assert sorted(r[0] for r in rows(issues, "issue_id")) == [f"REC-RUN-1-{n:03d}" for n in range(1, 8)]


def test_second_run_rejects_everything(spark, extract_dir, tmp_path):
    root = str(tmp_path / "w")
    run_batch(spark, extract_dir, root, run_id="RUN-A")
    second = run_batch(spark, extract_dir, root, run_id="RUN-B")
    assert (second["rows_loaded"], second["rows_rejected"]) == (0, 48)
    house = Warehouse(spark, root)
    assert house.latest_committed() == "RUN-B"
    assert house.run_parts("raw/incidents").count() == 6
    assert house.snapshot("core", "incidents").count() == 5
    assert house.snapshot("analytics", "follow_up_queue").count() == 3


def test_failure_is_recorded_and_keeps_the_last_good_tables(spark, extract_dir, tmp_path):
    root = str(tmp_path / "w")
    run_batch(spark, extract_dir, root, run_id="RUN-A")
    with pytest.raises(FileNotFoundError):
        run_batch(spark, str(tmp_path / "nowhere"), root, run_id="RUN-B")
    house = Warehouse(spark, root)
    failed = house.runs().where("pipeline_run_id = 'RUN-B'").first()
    assert failed.status == "FAILED" and "missing extract" in failed.error_message
    assert house.latest_committed() == "RUN-A"
    assert house.run_parts("ops/checks").count() == 41


def test_as_of_is_read_from_workflow_events(spark, core):
    from faultline.operators.workflow import default_as_of

    assert spark.range(1).select(default_as_of(core["events"]).alias("t")).first().t == datetime(2030, 3, 5, 3)


def test_issue_evidence_is_written_whole(batch):
    """Each issue that names a count has so many rows in the long table of the same run."""
    found = Counter((r.incident_id, r.issue_type, r.stage) for r in batch[1].run_parts("ops/issue_evidence").collect())
    expected = {}
    for r in batch[1].run_parts("ops/issues").collect():
        evidence = json.loads(r.evidence_json)
        count = evidence.get("event_count", evidence.get("work_order_count"))
        if count is not None:
            stage = evidence["stage"] if r.issue_type.endswith("duplicate_stage_entry") else None
            expected[r.incident_id, r.issue_type, stage] = count
    assert found == expected and found
