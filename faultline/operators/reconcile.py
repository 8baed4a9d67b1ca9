"""Reconciliation: do the core tables, the event history, the snapshots and the outputs agree?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import vocab
from faultline.functions.scalar import is_active, iso_text, json_object, lookup, truthy
from faultline.functions.scoring import high_impact
from faultline.operators import validators
from faultline.operators.skew import HOT_ROWS, ends, global_rank
from faultline.operators.validators import emit, issue
from faultline.session import checkpoint
from faultline.operators.workflow import default_as_of, event_profile, latest_snapshots


def state_issues(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """Core stage and status against the latest entered stage and the restore events."""
    profile = event_profile(events).select("incident_id", "latest_entered", "restore_count")
    seen = incidents.select("incident_id", "asset_id", "current_stage", "current_status").join(
        profile, "incident_id", "left"
    )
    has_entry = F.col("latest_entered").isNotNull()
    restores = F.coalesce("restore_count", F.lit(0))
    prefix = "state_reconstruction_"
    single = emit(
        seen,
        (
            ~has_entry,
            issue(
                prefix + "missing_stage_event",
                "The incident has no entered-stage event, so the current stage cannot be reconstructed from event "
                "history.",
                json_object(current_stage="current_stage", current_status="current_status"),
                asset="asset_id",
            ),
        ),
        (
            has_entry & (F.col("current_stage") != F.col("latest_entered.stage")),
            issue(
                prefix + "stage_mismatch",
                "The core current stage does not match the latest entered-stage event.",
                json_object(
                    core_current_stage="current_stage",
                    latest_entered_stage="latest_entered.stage",
                    latest_entered_event_id="latest_entered.event_id",
                ),
                asset="asset_id",
            ),
        ),
        (
            has_entry & ~is_active() & (restores == 0),
            issue(
                prefix + "missing_completion_event",
                "The incident is marked restored, but event history has no restore event.",
                json_object(current_status="current_status"),
                asset="asset_id",
            ),
        ),
    )
    contradicted = seen.where(has_entry & is_active() & (restores > 0)).drop("latest_entered", "restore_count")
    completions = events.where(F.col("event_type") == vocab.INCIDENT_RESTORED)
    lists = ends(
        completions.join(contradicted.select("incident_id"), "incident_id", "left_semi"),
        ["incident_id"],
        ["occurred_at", "event_id"],
        "event_id",
    )
    with_lists = emit(
        lists.join(contradicted, "incident_id"),
        (
            F.lit(True),
            issue(
                prefix + "active_with_completion_event",
                "The incident is still active, but event history contains a restore event.",
                json_object(
                    current_status="current_status", event_count="n", first_event_id="first", last_event_id="last"
                ),
                asset="asset_id",
            ),
        ),
    )
    return single.unionByName(with_lists)


def events_before_report(incidents: DataFrame, events: DataFrame) -> DataFrame:
    reported = incidents.select("incident_id", "reported_at")
    return events.join(reported, "incident_id").where(F.col("occurred_at") < F.col("reported_at")).drop("reported_at")


def event_sequence_issues(incidents: DataFrame, events: DataFrame) -> DataFrame:
    reported = incidents.select("incident_id", "asset_id", "reported_at")
    lists = ends(events_before_report(incidents, events), ["incident_id"], ["occurred_at", "event_id"], "event_id")
    return emit(
        lists.join(reported, "incident_id"),
        (
            F.lit(True),
            issue(
                "event_sequence_before_request",
                "A stage event occurred before the infrastructure request was reported.",
                json_object(
                    reported_at=iso_text("reported_at"), event_count="n", first_event_id="first", last_event_id="last"
                ),
                asset="asset_id",
            ),
        ),
    )


def orders_without_spare(work_orders: DataFrame) -> DataFrame:
    return work_orders.where((F.col("work_order_status") == "WAITING_SPARE_VENDOR") & ~truthy("required_spare_id"))


def spare_waiting_issues(incidents: DataFrame, work_orders: DataFrame) -> DataFrame:
    lists = ends(orders_without_spare(work_orders), ["incident_id"], ["work_order_id"], "work_order_id")
    return emit(
        lists.join(incidents.select("incident_id", "asset_id"), "incident_id", "left"),
        (
            F.lit(True),
            issue(
                "spare_waiting_missing_required_spare",
                "A work order is waiting on a spare or vendor, but no required spare is linked.",
                json_object(
                    work_order_count="n",
                    first_work_order_id="first",
                    last_work_order_id="last",
                    work_order_status=F.lit("WAITING_SPARE_VENDOR"),
                ),
                asset="asset_id",
            ),
        ),
    )


def validation_issues(incidents: DataFrame, work_orders: DataFrame, validations: DataFrame) -> DataFrame:
    done = work_orders.where(F.col("work_order_status").isin(vocab.COMPLETED_WORK)).select("incident_id")
    return emit(
        validations.join(done, "incident_id", "left_anti").join(
            incidents.select("incident_id", "asset_id"), "incident_id", "left"
        ),
        (
            F.lit(True),
            issue(
                "validation_without_completed_work",
                "A validation result exists before any completed infrastructure work is available.",
                json_object(validation_id="validation_id", validation_status="validation_status"),
                asset="asset_id",
            ),
        ),
    )


def output_issues(incidents: DataFrame, status: DataFrame) -> DataFrame:
    return emit(
        incidents.join(status.select("incident_id"), "incident_id", "left_anti"),
        (
            F.lit(True),
            issue(
                "analytics_output_missing_current_status",
                "Analytics did not produce a current-status row for a core infrastructure incident.",
                json_object(current_stage="current_stage", current_status="current_status"),
                asset="asset_id",
            ),
        ),
    )


def _judged(snapshots: DataFrame) -> DataFrame:
    """What the rules read of a snapshot; of its readings how many there are and whether one is abnormal."""
    abnormal = F.coalesce(
        F.exists(
            "telemetry_readings",
            lambda r: F.coalesce(F.upper(r["status"]).isin("WARNING", "CRITICAL"), F.lit(False)),
        ),
        F.lit(False),
    )
    return snapshots.select(
        "incident_id", "impact_snapshot_id", "snapshot_at", "redundancy_state", "power_redundancy_lost",
        "cooling_redundancy_lost", "vendor_status", "vendor_eta_at", "mitigation_status", "affected_gpu_count",
        "estimated_capacity_risk_kw", "thermal_breach_minutes", abnormal.alias("_abnormal"),
        F.coalesce(F.size("telemetry_readings"), F.lit(0)).alias("_readings"),
    )


def impact_issues(
    incidents: DataFrame, events: DataFrame, snapshots: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Eight rules on the latest snapshot (equal times: largest id) against the incident and its events.

    "A matching event at or before the snapshot" is asked as "the first such event is not later", so events are reduced
    to one row per incident before the join.
    """
    if as_of is None:
        as_of = F.coalesce(default_as_of(events), F.localtimestamp())
    rows = (
        incidents.select("incident_id", "asset_id", "priority_level", "business_impact", "current_stage",
                         "current_status")
        .join(latest_snapshots(_judged(snapshots), "desc"), "incident_id", "left")
        .join(event_profile(events), "incident_id", "left")
    )
    present = F.col("impact_snapshot_id").isNotNull()
    active = is_active()
    lost = (
        F.col("redundancy_state").isin("N", "N-1") | F.col("power_redundancy_lost") | F.col("cooling_redundancy_lost")
    )
    last_red = F.col("latest_redundancy.event_type")
    red_message = (
        F.when(
            (last_red == "REDUNDANCY_LOST") & ~lost,
            "Event history says redundancy was lost, but the latest impact snapshot still shows normal redundancy.",
        ).when(
            (last_red == "REDUNDANCY_RESTORED") & lost,
            "Event history says redundancy was restored, but the latest impact snapshot still shows redundancy loss.",
        )
    )
    expected = lookup("mitigation_status", {"LOAD_SHIFTED": "LOAD_SHIFTED", "RUNNING_DEGRADED": "MITIGATION_APPLIED"})
    first_expected = F.when(F.col("mitigation_status") == "LOAD_SHIFTED", F.col("first_load_shift")).otherwise(
        F.col("first_mitigation")
    )
    has_evidence = F.coalesce(first_expected <= F.col("snapshot_at"), F.lit(False))
    no_capacity = (
        (F.col("affected_gpu_count") == 0)
        & (F.col("estimated_capacity_risk_kw") == 0)
        & ~F.col("mitigation_status").isin("LOAD_SHIFTED", "RUNNING_DEGRADED")
    )

    def found(kind: str, message: str | Column, evidence: Column, severity: str = "WARNING") -> Column:
        return issue(kind, message, evidence, asset="asset_id", severity=severity)

    return emit(
        rows,
        (
            active & high_impact() & ~present,
            found(
                "impact_snapshot_missing_for_active_high_impact_incident",
                "The active high-impact incident has no impact snapshot, so capacity, redundancy, and vendor-risk "
                "context is unverified.",
                json_object(
                    priority_level="priority_level", business_impact="business_impact", current_stage="current_stage"
                ),
                "ERROR",
            ),
        ),
        (
            present & active & (F.col("latest_impact.occurred_at") > F.col("snapshot_at")),
            found(
                "impact_snapshot_stale_after_latest_impact_event",
                "A material impact event occurred after the latest impact snapshot, so the displayed impact context "
                "may be stale.",
                json_object(
                    latest_snapshot_id="impact_snapshot_id",
                    latest_snapshot_at=iso_text("snapshot_at"),
                    latest_event_id="latest_impact.event_id",
                    latest_event_type="latest_impact.event_type",
                    latest_event_at=iso_text("latest_impact.occurred_at"),
                ),
            ),
        ),
        (
            present & red_message.isNotNull(),
            found(
                "impact_redundancy_event_snapshot_mismatch",
                red_message,
                json_object(
                    latest_event_id="latest_redundancy.event_id",
                    latest_event_type="latest_redundancy.event_type",
                    redundancy_state="redundancy_state",
                    power_redundancy_lost="power_redundancy_lost",
                    cooling_redundancy_lost="cooling_redundancy_lost",
                ),
                "ERROR",
            ),
        ),
        (
            present
            & (F.col("latest_vendor.event_type") == "VENDOR_ETA_MISSED")
            & (F.col("vendor_status") != "ETA_MISSED"),
            found(
                "impact_vendor_eta_event_snapshot_mismatch",
                "Event history says the vendor ETA was missed, but the latest impact snapshot does not mark the vendor "
                "status as missed.",
                json_object(
                    latest_event_id="latest_vendor.event_id",
                    latest_event_type="latest_vendor.event_type",
                    vendor_status="vendor_status",
                    vendor_eta_at=iso_text("vendor_eta_at"),
                ),
                "ERROR",
            ),
        ),
        (
            present
            & active
            & (F.col("vendor_eta_at") < as_of)
            & F.col("vendor_status").isin("ETA_CONFIRMED", "WAITING_VENDOR_DISPATCH"),
            found(
                "impact_vendor_eta_past_not_missed",
                "The vendor ETA is older than the analytics as-of time, but the impact snapshot has not marked the "
                "ETA as missed.",
                json_object(
                    vendor_status="vendor_status",
                    vendor_eta_at=iso_text("vendor_eta_at"),
                    analytics_as_of=iso_text(as_of),
                ),
            ),
        ),
        (
            present & expected.isNotNull() & ~has_evidence,
            found(
                "impact_mitigation_without_event_evidence",
                "The impact snapshot reports mitigation, but event history has no matching mitigation evidence before "
                "the snapshot.",
                json_object(
                    mitigation_status="mitigation_status",
                    expected_event_type=expected,
                    latest_snapshot_id="impact_snapshot_id",
                    latest_snapshot_at=iso_text("snapshot_at"),
                ),
            ),
        ),
        (
            present & active & (F.col("thermal_breach_minutes") > 0) & ~F.col("_abnormal"),
            found(
                "impact_thermal_context_missing_evidence",
                "The impact snapshot reports thermal breach minutes, but no warning or critical telemetry reading is "
                "attached.",
                json_object(
                    thermal_breach_minutes="thermal_breach_minutes",
                    telemetry_reading_count="_readings",
                    latest_snapshot_id="impact_snapshot_id",
                ),
            ),
        ),
        (
            present & active & high_impact() & no_capacity,
            found(
                "impact_capacity_risk_zero_for_critical_gpu_incident",
                "The incident is active and high impact, but the latest impact snapshot reports no affected GPU or "
                "capacity risk.",
                json_object(
                    priority_level="priority_level",
                    business_impact="business_impact",
                    affected_gpu_count="affected_gpu_count",
                    estimated_capacity_risk_kw="estimated_capacity_risk_kw",
                    mitigation_status="mitigation_status",
                ),
            ),
        ),
    )


def all_issues(
    incidents: DataFrame,
    events: DataFrame,
    work_orders: DataFrame,
    validations: DataFrame,
    snapshots: DataFrame,
    status: DataFrame,
    as_of: Column | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Every reconciliation issue of a run, in the common issue schema."""
    parts = issue_parts(incidents, events, work_orders, validations, snapshots, status, as_of, hot_rows)
    return reduce(DataFrame.unionByName, parts)


def issue_parts(
    incidents: DataFrame,
    events: DataFrame,
    work_orders: DataFrame,
    validations: DataFrame,
    snapshots: DataFrame,
    status: DataFrame,
    as_of: Column | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> list[DataFrame]:
    """The same in three parts: the rules of transition, which sort the whole history, those on the outputs, and what is left."""
    rest = [
        validators.incident_vocabulary(incidents),
        validators.event_vocabulary(events),
        validators.impact_vocabulary(snapshots, incidents),
        state_issues(incidents, events),
        event_sequence_issues(incidents, events),
        spare_waiting_issues(incidents, work_orders),
        validation_issues(incidents, work_orders, validations),
        impact_issues(incidents, events, snapshots, as_of),
    ]
    transitions, outputs = validators.transition_rules(events, incidents, hot_rows), output_issues(incidents, status)
    return [transitions, outputs, reduce(DataFrame.unionByName, rest)]


def issue_evidence(incidents: DataFrame, events: DataFrame, work_orders: DataFrame) -> DataFrame:
    """All records behind the issues that name a count: one row per issue and record, however many there are."""
    # written once, as five rules read them
    events = checkpoint(events.select("incident_id", "event_id", "stage", "event_type", "occurred_at"))
    incidents = checkpoint(incidents.select("incident_id", "current_status", "reported_at"))
    entries = validators.entered_events(events)
    repeated = entries.groupBy("incident_id", "stage").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    completions = events.where(F.col("event_type") == vocab.INCIDENT_RESTORED)
    # an entry of a stage outside the vocabulary counts here, as in state_issues
    entered = events.where(F.col("event_type") == vocab.ENTERED).select("incident_id").distinct()
    active = incidents.where(is_active()).select("incident_id")
    contradicted = completions.join(active, "incident_id", "left_semi").join(entered, "incident_id", "left_semi")

    def rows(df: DataFrame, kind: str, record: str, stage: str | None = None) -> DataFrame:
        return df.select(
            "incident_id",
            F.lit(kind).alias("issue_type"),
            (F.col(stage) if stage else F.lit(None).cast("string")).alias("stage"),
            F.col(record).alias("record_id"),
        )

    ontology = "workflow_ontology_"
    parts = [
        rows(
            entries.join(repeated.select("incident_id", "stage"), ["incident_id", "stage"], "left_semi"),
            ontology + "duplicate_stage_entry",
            "event_id",
            "stage",
        ),
        rows(validators.early_terminal_events(events, incidents), ontology + "invalid_restored_state", "event_id"),
        rows(contradicted, "state_reconstruction_active_with_completion_event", "event_id"),
        rows(events_before_report(incidents, events), "event_sequence_before_request", "event_id"),
        rows(orders_without_spare(work_orders), "spare_waiting_missing_required_spare", "work_order_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def numbered_issues(issues: DataFrame, run_id: str) -> DataFrame:
    """Issue ids REC-run-nnn in (incident, type, severity) order; the evidence text breaks ties."""
    ordered = global_rank(
        issues.withColumn("_incident", F.coalesce("incident_id", F.lit(""))),
        [F.asc("_incident"), F.asc("issue_type"), F.asc("severity"), F.asc("evidence_json"), F.asc("message")],
        "_number",
    )
    number = F.col("_number").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return ordered.select(
        F.concat(F.lit(f"REC-{run_id}-"), padded).alias("issue_id"),
        F.lit(run_id).alias("pipeline_run_id"),
        "incident_id",
        "asset_id",
        "issue_type",
        "severity",
        F.lit("OPEN").alias("status"),
        "message",
        "evidence_json",
    )
