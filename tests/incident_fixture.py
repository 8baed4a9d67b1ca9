"""Five small incidents of a pump house, written out event by event. Expected numbers in the tests are worked out by hand.

P1  pump 1, closed after 4 hours, nothing late.
P2  pump 2, waits for a spare that is out of stock, and the vendor missed the date.
P3  valve, in triage.
P4  pump 1 again, in repair; its work order names no spare though it waits for one, and one of its events is too early.
P5  valve, no event at all.
The last workflow event is P3's entry into triage, 2030-03-04T03:00; outputs are as of a day later, 2030-03-05T03:00.
So P2 waits for 91 hours (limit 18), P3 for 24 (limit 8), P4 for 51 (limit 24).
"""

import json

from faultline.vocab import SOURCE_SYSTEM


def record(key, payload):
    return {"source_system": SOURCE_SYSTEM, "source_record_id": key, "payload": payload}


def incident(key, asset, zone, priority, reported, needed, stage, status="IN_PROGRESS", estimate=4, actual=None, impact="NOISE"):
    return {
        "incident_id": key, "request_number": f"R/{key}", "asset_id": asset, "zone_id": zone, "request_title": f"{key} at {asset}",
        "request_type": "CORRECTIVE", "priority_level": priority, "failure_mode": "LEAK" if asset == "PUMP-1" else "STUCK",
        "reported_at": reported, "needed_by_at": needed, "current_stage": stage, "current_status": status,
        "business_impact": impact, "estimated_downtime_hours": estimate, "actual_downtime_hours": actual,
    }


INCIDENTS = [
    incident("P1", "PUMP-1", "WEST", "LOW", "2030-03-01T00:00:00Z", "2030-03-02T00:00:00Z", "RESTORED", "RESTORED", 4, 4),
    incident("P2", "PUMP-2", "WEST", "CRITICAL", "2030-03-01T06:00:00Z", "2030-03-02T06:00:00Z", "SPARE_VENDOR_WAITING",
             estimate=20, impact="COOLING_RISK"),
    incident("P3", "VALVE", "EAST", "MEDIUM", "2030-03-04T02:00:00Z", "2030-03-05T02:00:00Z", "FACILITIES_TRIAGE"),
    incident("P4", "PUMP-1", "WEST", "MEDIUM", "2030-03-02T18:00:00Z", "2030-03-04T20:00:00Z", "REPAIR_IN_PROGRESS", estimate=10),
    incident("P5", "VALVE", "EAST", "LOW", "2030-03-01T00:00:00Z", "2030-03-09T00:00:00Z", "INCIDENT_REPORTED"),
]
# event id, incident, stage, type, time
EVENTS = [
    ("a1", "P1", "INCIDENT_REPORTED", "ENTERED_STAGE", "2030-03-01T00:00:00Z"),
    ("a2", "P1", "INCIDENT_REPORTED", "INCIDENT_ACCEPTED", "2030-03-01T00:30:00Z"),
    ("a3", "P1", "FACILITIES_TRIAGE", "ENTERED_STAGE", "2030-03-01T00:30:00Z"),
    ("a4", "P1", "FACILITIES_TRIAGE", "TRIAGE_COMPLETED", "2030-03-01T01:00:00Z"),
    ("a5", "P1", "ENGINEER_ASSIGNED", "ENTERED_STAGE", "2030-03-01T01:00:00Z"),
    ("a6", "P1", "ENGINEER_ASSIGNED", "ENGINEER_ASSIGNED", "2030-03-01T01:30:00Z"),
    ("a7", "P1", "SPARE_VENDOR_WAITING", "ENTERED_STAGE", "2030-03-01T01:30:00Z"),
    ("a8", "P1", "SPARE_VENDOR_WAITING", "SPARE_OR_VENDOR_READY", "2030-03-01T02:00:00Z"),
    ("a9", "P1", "REPAIR_IN_PROGRESS", "ENTERED_STAGE", "2030-03-01T02:00:00Z"),
    ("b0", "P1", "REPAIR_IN_PROGRESS", "REPAIR_COMPLETED", "2030-03-01T03:00:00Z"),
    ("b1", "P1", "VALIDATION", "ENTERED_STAGE", "2030-03-01T03:00:00Z"),
    ("b2", "P1", "VALIDATION", "VALIDATION_PASSED", "2030-03-01T04:00:00Z"),
    ("b3", "P1", "RESTORED", "ENTERED_STAGE", "2030-03-01T04:00:00Z"),
    ("b4", "P1", "RESTORED", "INCIDENT_RESTORED", "2030-03-01T04:00:00Z"),
    ("c1", "P2", "INCIDENT_REPORTED", "ENTERED_STAGE", "2030-03-01T06:00:00Z"),
    ("c2", "P2", "INCIDENT_REPORTED", "INCIDENT_ACCEPTED", "2030-03-01T07:00:00Z"),
    ("c3", "P2", "FACILITIES_TRIAGE", "ENTERED_STAGE", "2030-03-01T07:00:00Z"),
    ("c4", "P2", "FACILITIES_TRIAGE", "TRIAGE_COMPLETED", "2030-03-01T07:30:00Z"),
    ("c5", "P2", "ENGINEER_ASSIGNED", "ENTERED_STAGE", "2030-03-01T07:30:00Z"),
    ("c6", "P2", "ENGINEER_ASSIGNED", "ENGINEER_ASSIGNED", "2030-03-01T08:00:00Z"),
    ("c7", "P2", "SPARE_VENDOR_WAITING", "ENTERED_STAGE", "2030-03-01T08:00:00Z"),
    ("c8", "P2", "SPARE_VENDOR_WAITING", "VENDOR_ETA_MISSED", "2030-03-04T06:00:00Z"),
    ("d1", "P3", "INCIDENT_REPORTED", "ENTERED_STAGE", "2030-03-04T02:00:00Z"),
    ("d2", "P3", "INCIDENT_REPORTED", "INCIDENT_ACCEPTED", "2030-03-04T03:00:00Z"),
    ("d3", "P3", "FACILITIES_TRIAGE", "ENTERED_STAGE", "2030-03-04T03:00:00Z"),
    ("e1", "P4", "INCIDENT_REPORTED", "ENTERED_STAGE", "2030-03-02T18:00:00Z"),
    ("e2", "P4", "INCIDENT_REPORTED", "INCIDENT_ACCEPTED", "2030-03-02T19:00:00Z"),
    ("e3", "P4", "FACILITIES_TRIAGE", "ENTERED_STAGE", "2030-03-02T19:00:00Z"),
    ("e4", "P4", "FACILITIES_TRIAGE", "TRIAGE_COMPLETED", "2030-03-02T21:00:00Z"),
    ("e5", "P4", "ENGINEER_ASSIGNED", "ENTERED_STAGE", "2030-03-02T21:00:00Z"),
    ("e6", "P4", "ENGINEER_ASSIGNED", "ENGINEER_ASSIGNED", "2030-03-02T22:00:00Z"),
    ("e7", "P4", "SPARE_VENDOR_WAITING", "ENTERED_STAGE", "2030-03-02T22:00:00Z"),
    ("e8", "P4", "SPARE_VENDOR_WAITING", "SPARE_OR_VENDOR_READY", "2030-03-03T00:00:00Z"),
    ("e9", "P4", "REPAIR_IN_PROGRESS", "ENTERED_STAGE", "2030-03-03T00:00:00Z"),
    ("f0", "P4", "REPAIR_IN_PROGRESS", "LOAD_SHIFTED", "2030-03-02T17:00:00Z"),
]


def event(key, owner, stage, kind, at):
    return {
        "event_id": key, "incident_id": owner, "stage": stage, "event_type": kind, "event_status": "SUCCESS", "occurred_at": at,
        "actor_type": "SYSTEM", "actor_id": None, "reason_code": None, "metadata_json": {"note": key}, "source_system": SOURCE_SYSTEM,
    }


def order(key, owner, status, spare, team="Wet crew"):
    return {"work_order_id": key, "incident_id": owner, "assigned_team": team, "assigned_engineer_id": None,
            "work_order_status": status, "required_spare_id": spare}


def snapshot(key, owner, asset, zone, at, **values):
    plain = {
        "redundancy_state": "N+1", "affected_rack_count": 0, "affected_gpu_count": 0, "estimated_capacity_risk_kw": 0.0,
        "estimated_gpu_capacity_risk_pct": 0.0, "thermal_breach_minutes": 0, "power_redundancy_lost": False,
        "cooling_redundancy_lost": False, "mitigation_status": "NONE", "vendor_eta_at": None, "vendor_status": "NOT_REQUIRED",
    }
    return {"impact_snapshot_id": key, "incident_id": owner, "asset_id": asset, "zone_id": zone, "snapshot_at": at, **plain, **values,
            "source_system": SOURCE_SYSTEM, "metadata_json": {}, "telemetry_readings_json": []}


def build():
    """The records of each extract, among them an incident sent twice and one that lacks most fields."""
    incidents = [record(f"i-{i['incident_id']}", i) for i in INCIDENTS]
    again = record("i-P1", INCIDENTS[0] | {"incident_id": "P1-again"})
    partial = record("i-partial", {"incident_id": "PX", "asset_id": "VALVE"})
    return {
        "infrastructure_incidents": [*incidents, again, partial],
        "incident_stage_events": [record(f"e-{e[0]}", event(*e)) for e in EVENTS],
        "facility_work_orders": [
            record("w-1", order("W1", "P1", "RESTORED", "SEAL")),
            record("w-2", order("W2", "P2", "WAITING_SPARE_VENDOR", "ROTOR")),
            record("w-4", order("W4", "P4", "WAITING_SPARE_VENDOR", None)),
        ],
        "validation_results": [
            record("v-1", {"validation_id": "V1", "incident_id": "P1", "validation_status": "PASSED"}),
            record("v-3", {"validation_id": "V3", "incident_id": "P3", "validation_status": "PASSED"}),
        ],
        "telemetry_alerts": [
            record("t-1", {"telemetry_alert_id": "T1", "asset_id": "PUMP-2", "alert_type": "PRESSURE", "severity": "WARNING",
                           "triggered_at": "2030-03-01T05:00:00Z", "linked_incident_id": "P2"}),
        ],
        "infrastructure_impact_snapshots": [
            record("s-2", snapshot("S2", "P2", "PUMP-2", "WEST", "2030-03-04T06:00:00Z", redundancy_state="N-1",
                                   affected_gpu_count=100, estimated_capacity_risk_kw=262.5, thermal_breach_minutes=30,
                                   cooling_redundancy_lost=True, vendor_status="ETA_MISSED")),
            record("s-4", snapshot("S4", "P4", "PUMP-1", "WEST", "2030-03-03T00:00:00Z", mitigation_status="RUNNING_DEGRADED")),
        ],
        "infrastructure_zones": [
            {"zone_id": z, "zone_code": z, "zone_name": f"{z} side", "facility_area": "YARD", "zone_priority": p, "current_status": "RUNNING"}
            for z, p in (("WEST", "HIGH"), ("EAST", "LOW"))
        ],
        "infrastructure_assets": [
            {"asset_id": a, "asset_code": a, "asset_name": a, "asset_type": kind, "zone_id": zone, "criticality_level": level,
             "installed_at": "2029-01-01T00:00:00Z", "manufacturer": "Own", "model_number": "1", "current_status": "RUNNING"}
            for a, kind, zone, level in (("PUMP-1", "UPS", "WEST", "LOW"), ("PUMP-2", "CHILLER", "WEST", "CRITICAL"), ("VALVE", "PDU", "EAST", "MEDIUM"))
        ],
        "critical_spares": [
            {"spare_id": s, "spare_number": s, "spare_name": s, "spare_category": "WET", "stock_status": stock, "lead_time_days": 1,
             "critical_spare": critical}
            for s, stock, critical in (("SEAL", "IN_STOCK", False), ("ROTOR", "OUT_OF_STOCK", True))
        ],
        "infrastructure_dependencies": [
            {"dependency_id": d, "dependent_asset_id": a, "dependency_asset_id": b, "dependency_type": "COOLING_PATH",
             "dependency_role": "PRIMARY", "impact_scope": "YARD", "source_system": SOURCE_SYSTEM, "metadata_json": {}}
            for d, a, b in (("D1", "PUMP-2", "PUMP-1"), ("D2", "VALVE", "PUMP-2"))
        ],
        "facilities_engineers": [
            {"engineer_id": "ANN", "engineer_name": "Ann", "team_name": "Wet crew", "skill_group": "WET", "shift": "DAY", "active_status": True}
        ],
    }


def write_extracts(folder, data=None):
    for name, records in (data or build()).items():
        (folder / f"{name}.json").write_text(json.dumps(records, indent=1))
