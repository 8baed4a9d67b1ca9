"""Feed contracts: what each extract must carry. One table drives loading, required-field and date checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Feed:
    """A source extract. ``core`` is the short name of the core table it ends up in."""

    core: str
    source_name: str
    extract_file: str
    target_table: str
    cadence: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    notes: str
    dates: tuple[str, ...] = ()

    @property
    def fields(self) -> tuple[str, ...]:
        return self.required + self.optional


ACTIVE_CADENCE = "15 minutes during active operations"

# --- fixed values: field names, cadences and notes of the feeds ----------------------------------
RAW_FEEDS = (
    Feed(
        "incidents",
        "incident_management",
        "infrastructure_incidents.json",
        "raw_infrastructure_incidents",
        ACTIVE_CADENCE,
        ("incident_id", "request_number", "asset_id", "zone_id", "request_title", "request_type", "priority_level",
         "failure_mode", "reported_at", "needed_by_at", "current_stage", "current_status", "business_impact",
         "estimated_downtime_hours"),
        ("actual_downtime_hours", "scenario_key"),
        "Source of record for incident identity, lifecycle status, priority, and business impact.",
        ("reported_at", "needed_by_at"),
    ),
    Feed(
        "events",
        "workflow_events",
        "incident_stage_events.json",
        "raw_incident_stage_events",
        ACTIVE_CADENCE,
        ("event_id", "incident_id", "stage", "event_type", "event_status", "occurred_at", "actor_type",
         "source_system"),
        ("actor_id", "reason_code", "metadata_json"),
        "Append-only lifecycle and impact evidence used to reconstruct workflow state.",
        ("occurred_at",),
    ),
    Feed(
        "work_orders",
        "facility_work_orders",
        "facility_work_orders.json",
        "raw_facility_work_orders",
        ACTIVE_CADENCE,
        ("work_order_id", "incident_id", "assigned_team", "work_order_status"),
        ("assigned_engineer_id", "planned_start_at", "actual_start_at", "actual_completed_at", "required_spare_id"),
        "Maintenance execution evidence for assignment, repair progress, and spare/vendor blockers.",
        ("planned_start_at", "actual_start_at", "actual_completed_at"),
    ),
    Feed(
        "validations",
        "validation_results",
        "validation_results.json",
        "raw_validation_results",
        ACTIVE_CADENCE,
        ("validation_id", "incident_id", "validation_status"),
        ("validator_id", "validation_started_at", "validation_completed_at", "failure_reason"),
        "Return-to-service validation evidence after repair completion.",
        ("validation_started_at", "validation_completed_at"),
    ),
    Feed(
        "alerts",
        "telemetry_alerts",
        "telemetry_alerts.json",
        "raw_telemetry_alerts",
        "5 to 15 minutes based on monitoring export cost",
        ("telemetry_alert_id", "asset_id", "alert_type", "severity", "triggered_at"),
        ("resolved_at", "linked_incident_id", "metadata_json"),
        "Operational telemetry evidence linked to incident impact and trust checks.",
        ("triggered_at", "resolved_at"),
    ),
)
TOPOLOGY_FEED = Feed(
    "dependencies",
    "infrastructure_topology",
    "infrastructure_dependencies.json",
    "infrastructure_dependencies",
    "daily or on approved configuration change",
    ("dependency_id", "dependent_asset_id", "dependency_asset_id", "dependency_type", "dependency_role",
     "impact_scope", "source_system"),
    ("metadata_json",),
    "Read-only dependency graph extract. It must not contain credentials or live connector secrets.",
)
MASTER_FILES = {
    "zones": "infrastructure_zones.json",
    "assets": "infrastructure_assets.json",
    "dependencies": "infrastructure_dependencies.json",
    "engineers": "facilities_engineers.json",
    "spares": "critical_spares.json",
}
SNAPSHOT_FILE = "infrastructure_impact_snapshots.json"
CORE_TABLE_NAMES = {
    "zones": "infrastructure_zones",
    "assets": "infrastructure_assets",
    "dependencies": "infrastructure_dependencies",
    "engineers": "facilities_engineers",
    "spares": "critical_spares",
    "incidents": "infrastructure_incidents",
    "events": "incident_stage_events",
    "work_orders": "facility_work_orders",
    "validations": "validation_results",
    "alerts": "telemetry_alerts",
    "snapshots": "infrastructure_impact_snapshots",
}
FEED_BY_CORE = {feed.core: feed for feed in RAW_FEEDS}


def contract_table(spark: SparkSession) -> DataFrame:
    """The six contracts as rows."""
    rows = [
        (f.source_name, f.extract_file, f.target_table, f.cadence, list(f.required), list(f.optional), f.notes)
        for f in (*RAW_FEEDS, TOPOLOGY_FEED)
    ]
    schema = (
        "source_name STRING, extract_file STRING, target_table STRING, cadence STRING, "
        "required_payload_fields ARRAY<STRING>, optional_payload_fields ARRAY<STRING>, notes STRING"
    )
    return spark.createDataFrame(rows, schema)
