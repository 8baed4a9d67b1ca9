"""Controlled vocabulary of the incident workflow. Every constant here is a fixed value the results depend on."""

# --- fixed values: workflow -------------------------------------------------------------------
SOURCE_SYSTEM = "sample_ai_data_center_infrastructure_system"

STAGES = [
    "INCIDENT_REPORTED",
    "FACILITIES_TRIAGE",
    "ENGINEER_ASSIGNED",
    "SPARE_VENDOR_WAITING",
    "REPAIR_IN_PROGRESS",
    "VALIDATION",
    "RESTORED",
]
RESTORED = "RESTORED"
THRESHOLD_HOURS = {
    "INCIDENT_REPORTED": 2,
    "FACILITIES_TRIAGE": 8,
    "ENGINEER_ASSIGNED": 6,
    "SPARE_VENDOR_WAITING": 18,
    "REPAIR_IN_PROGRESS": 24,
    "VALIDATION": 8,
}
EXIT_EVENT = {
    "INCIDENT_REPORTED": "INCIDENT_ACCEPTED",
    "FACILITIES_TRIAGE": "TRIAGE_COMPLETED",
    "ENGINEER_ASSIGNED": "ENGINEER_ASSIGNED",
    "SPARE_VENDOR_WAITING": "SPARE_OR_VENDOR_READY",
    "REPAIR_IN_PROGRESS": "REPAIR_COMPLETED",
    "VALIDATION": "VALIDATION_PASSED",
}
ENTERED = "ENTERED_STAGE"
INCIDENT_RESTORED = "INCIDENT_RESTORED"
VALIDATION_FAILED = "VALIDATION_FAILED"
IMPACT_EVENTS = [
    "LOAD_SHIFTED",
    "MITIGATION_APPLIED",
    "REDUNDANCY_LOST",
    "REDUNDANCY_RESTORED",
    "VENDOR_ETA_MISSED",
    "VENDOR_ETA_UPDATED",
]
EVENT_TYPES = sorted({*EXIT_EVENT.values(), *IMPACT_EVENTS, ENTERED, INCIDENT_RESTORED, VALIDATION_FAILED})
OWNER_TYPE = {
    "INCIDENT_REPORTED": "MONITORING",
    "FACILITIES_TRIAGE": "FACILITIES_PLANNER",
    "ENGINEER_ASSIGNED": "FACILITIES_SUPERVISOR",
    "SPARE_VENDOR_WAITING": "SPARES_OR_VENDOR",
    "REPAIR_IN_PROGRESS": "FACILITIES_ENGINEER",
    "VALIDATION": "VALIDATION_ENGINEER",
    "RESTORED": "NONE",
}

# --- fixed values: allowed column values ------------------------------------------------------
EVENT_STATUSES = ["SUCCESS", "ACTION_REQUIRED", "FAILED"]
LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
INCIDENT_STATUSES = ["IN_PROGRESS", "RESTORED"]
OPERATIONAL_STATUSES = ["RUNNING", "DEGRADED", "STOPPED", "LOCKED_OUT", "AT_RISK"]
STOCK_STATUSES = ["IN_STOCK", "LOW_STOCK", "OUT_OF_STOCK"]
WORK_ORDER_STATUSES = [
    "ASSIGNED",
    "ASSIGNMENT_PENDING",
    "WAITING_SPARE_VENDOR",
    "IN_PROGRESS",
    "REPAIR_COMPLETED",
    "RESTORED",
]
COMPLETED_WORK = ["REPAIR_COMPLETED", "RESTORED"]
VALIDATION_STATUSES = ["PASSED", "PENDING", "FAILED"]
SEVERITIES = ["INFO", "WARNING", "CRITICAL"]
REDUNDANCY_STATES = ["N+1", "N", "N-1"]
MITIGATIONS = ["NONE", "LOAD_SHIFTED", "RUNNING_DEGRADED", "VERIFIED_NORMAL"]
VENDOR_STATUSES = ["NOT_REQUIRED", "ETA_CONFIRMED", "WAITING_VENDOR_DISPATCH", "ETA_MISSED"]
DEPENDENCY_TYPES = ["POWER_PATH", "COOLING_PATH", "CONTROL_TELEMETRY", "REDUNDANCY_SUPPORT"]
DEPENDENCY_ROLES = ["PRIMARY", "SECONDARY", "BACKUP"]
HIGH_IMPACT_PATTERN = "CAPACITY|COOLING|GPU|POWER|REDUNDANCY"

# --- fixed values: score tables ---------------------------------------------------------------
CRITICALITY_SCORE = {"LOW": 5.0, "MEDIUM": 12.0, "HIGH": 22.0, "CRITICAL": 35.0}
ZONE_SCORE = {"LOW": 4.0, "MEDIUM": 8.0, "HIGH": 16.0, "CRITICAL": 24.0}
MITIGATION_CREDIT = {"LOAD_SHIFTED": 8.0, "RUNNING_DEGRADED": 4.0, "VERIFIED_NORMAL": 2.0}

# --- fixed values: operator-facing labels of reconciliation issues -----------------------------
ISSUE_LABELS = {
    "analytics_output_missing_current_status": "Analytics output gap",
    "event_sequence_before_request": "Event timeline mismatch",
    "impact_capacity_risk_zero_for_critical_gpu_incident": "Impact capacity gap",
    "impact_mitigation_without_event_evidence": "Impact mitigation evidence gap",
    "impact_redundancy_event_snapshot_mismatch": "Impact redundancy mismatch",
    "impact_snapshot_missing_for_active_high_impact_incident": "Impact snapshot gap",
    "impact_snapshot_stale_after_latest_impact_event": "Impact snapshot stale",
    "impact_thermal_context_missing_evidence": "Impact thermal evidence gap",
    "impact_vendor_eta_event_snapshot_mismatch": "Impact vendor ETA mismatch",
    "impact_vendor_eta_past_not_missed": "Impact vendor ETA stale",
    "validation_without_completed_work": "Validation sequence mismatch",
    "spare_waiting_missing_required_spare": "Spare or vendor evidence mismatch",
    "state_reconstruction_active_with_completion_event": "State reconstruction mismatch",
    "state_reconstruction_missing_completion_event": "State reconstruction gap",
    "state_reconstruction_missing_stage_event": "State reconstruction gap",
    "state_reconstruction_stage_mismatch": "State reconstruction mismatch",
    "workflow_ontology_duplicate_stage_entry": "Workflow ontology duplicate stage",
    "workflow_ontology_invalid_event_status": "Workflow ontology event status mismatch",
    "workflow_ontology_invalid_event_type": "Workflow ontology event type mismatch",
    "workflow_ontology_invalid_mitigation_status": "Workflow ontology mitigation mismatch",
    "workflow_ontology_invalid_priority": "Workflow ontology priority mismatch",
    "workflow_ontology_invalid_redundancy_state": "Workflow ontology redundancy mismatch",
    "workflow_ontology_invalid_restored_state": "Workflow ontology restore mismatch",
    "workflow_ontology_invalid_stage": "Workflow ontology stage mismatch",
    "workflow_ontology_invalid_stage_event_type": "Workflow ontology stage event mismatch",
    "workflow_ontology_invalid_stage_progression": "Workflow ontology transition mismatch",
    "workflow_ontology_invalid_status": "Workflow ontology status mismatch",
    "workflow_ontology_invalid_vendor_status": "Workflow ontology vendor mismatch",
}
DEFAULT_ISSUE_LABEL = "Reconciliation issue"
IMPACT_ISSUES = [name for name in ISSUE_LABELS if name.startswith("impact_")]
