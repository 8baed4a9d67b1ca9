"""Schemas of the raw envelope, the eleven core tables and the run-scoped tables, as DDL strings."""

ENVELOPE = "source_system STRING, source_record_id STRING, payload STRING"

READING = "STRUCT<metric: STRING, value: DOUBLE, unit: STRING, status: STRING>"

CORE = {
    "zones": "zone_id STRING, zone_code STRING, zone_name STRING, facility_area STRING, zone_priority STRING, "
    "current_status STRING",
    "assets": "asset_id STRING, asset_code STRING, asset_name STRING, asset_type STRING, zone_id STRING, "
    "criticality_level STRING, installed_at TIMESTAMP_NTZ, manufacturer STRING, model_number STRING, "
    "current_status STRING",
    "dependencies": "dependency_id STRING, dependent_asset_id STRING, dependency_asset_id STRING, "
    "dependency_type STRING, dependency_role STRING, impact_scope STRING, source_system STRING, "
    "metadata_json STRING",
    "engineers": "engineer_id STRING, engineer_name STRING, team_name STRING, skill_group STRING, shift STRING, "
    "active_status BOOLEAN",
    "spares": "spare_id STRING, spare_number STRING, spare_name STRING, spare_category STRING, stock_status STRING, "
    "lead_time_days DOUBLE, critical_spare BOOLEAN",
    "incidents": "incident_id STRING, request_number STRING, asset_id STRING, zone_id STRING, request_title STRING, "
    "request_type STRING, priority_level STRING, failure_mode STRING, reported_at TIMESTAMP_NTZ, "
    "needed_by_at TIMESTAMP_NTZ, current_stage STRING, current_status STRING, business_impact STRING, "
    "estimated_downtime_hours DOUBLE, actual_downtime_hours DOUBLE",
    "events": "event_id STRING, incident_id STRING, stage STRING, event_type STRING, event_status STRING, "
    "occurred_at TIMESTAMP_NTZ, actor_type STRING, actor_id STRING, reason_code STRING, metadata_json STRING, "
    "source_system STRING",
    "work_orders": "work_order_id STRING, incident_id STRING, assigned_team STRING, assigned_engineer_id STRING, "
    "work_order_status STRING, planned_start_at TIMESTAMP_NTZ, actual_start_at TIMESTAMP_NTZ, "
    "actual_completed_at TIMESTAMP_NTZ, required_spare_id STRING",
    "validations": "validation_id STRING, incident_id STRING, validation_status STRING, validator_id STRING, "
    "validation_started_at TIMESTAMP_NTZ, validation_completed_at TIMESTAMP_NTZ, failure_reason STRING",
    "alerts": "telemetry_alert_id STRING, asset_id STRING, alert_type STRING, severity STRING, "
    "triggered_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ, linked_incident_id STRING, metadata_json STRING",
    "snapshots": "impact_snapshot_id STRING, incident_id STRING, asset_id STRING, zone_id STRING, "
    "snapshot_at TIMESTAMP_NTZ, redundancy_state STRING, affected_rack_count INT, affected_gpu_count INT, "
    "estimated_capacity_risk_kw DOUBLE, estimated_gpu_capacity_risk_pct DOUBLE, thermal_breach_minutes INT, "
    "power_redundancy_lost BOOLEAN, cooling_redundancy_lost BOOLEAN, mitigation_status STRING, "
    "vendor_eta_at TIMESTAMP_NTZ, vendor_status STRING, source_system STRING, metadata_json STRING, "
    f"telemetry_readings ARRAY<{READING}>",
}
PRIMARY_KEY = {
    "zones": "zone_id",
    "assets": "asset_id",
    "dependencies": "dependency_id",
    "engineers": "engineer_id",
    "spares": "spare_id",
    "incidents": "incident_id",
    "events": "event_id",
    "work_orders": "work_order_id",
    "validations": "validation_id",
    "alerts": "telemetry_alert_id",
    "snapshots": "impact_snapshot_id",
}
POSITION = "STRUCT<file: STRING, block: BIGINT, row: BIGINT>"
ORDER = f"STRUCT<run_at: TIMESTAMP_NTZ, position: {POSITION}>"

ISSUE = (
    "incident_id STRING, asset_id STRING, issue_type STRING, severity STRING, message STRING, evidence_json STRING"
)
RUN = (
    "pipeline_run_id STRING, pipeline_name STRING, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ, "
    "status STRING, rows_extracted BIGINT, rows_loaded BIGINT, rows_rejected BIGINT, quality_failed_checks BIGINT, "
    "core_records_loaded BIGINT, core_records_skipped BIGINT, analytics_records_loaded BIGINT, "
    "reconciliation_issues_created BIGINT, error_message STRING"
)
TRIPLE = "graph STRING, s STRING, p STRING, o STRING, o_kind STRING, o_datatype STRING"


def column_names(ddl: str) -> list[str]:
    """Top-level column names of one of the flat DDL strings above."""
    depth, names, word = 0, [], ""
    for char in ddl + ",":
        depth += (char in "<(") - (char in ">)")
        if char == "," and depth == 0:
            names.append(word.split()[0])
            word = ""
        else:
            word += char
    return names
