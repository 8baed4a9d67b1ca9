"""Follow-up score components as column expressions over one joined row per active incident."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import vocab
from faultline.functions.scalar import hours_between, iso_text, lookup, round_even

COMPONENTS = [
    "asset_criticality_score",
    "downtime_score",
    "stage_delay_score",
    "infrastructure_zone_impact_score",
    "needed_by_urgency_score",
    "repeat_failure_score",
    "spare_risk_score",
    "capacity_risk_score",
    "redundancy_risk_score",
    "thermal_risk_score",
    "vendor_eta_risk_score",
    "mitigation_credit_score",
]


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def urgency(needed_by: Column, as_of: Column) -> Column:
    left = hours_between(as_of, needed_by)
    return (
        F.when(left < 0, 24.0).when(left <= 12, 18.0).when(left <= 24, 12.0).when(left <= 72, 6.0).otherwise(2.0)
    )


def lost_redundancy() -> Column:
    return F.col("power_redundancy_lost") | F.col("cooling_redundancy_lost")


def vendor_risk(as_of: Column) -> Column:
    status = F.col("vendor_status")
    overdue = (F.col("vendor_eta_at") < as_of) & (status != "NOT_REQUIRED")
    return (
        F.when(status == "ETA_MISSED", 22.0)
        .when(overdue, 18.0)
        .when(status == "WAITING_VENDOR_DISPATCH", 14.0)
        .when(status == "ETA_CONFIRMED", 6.0)
        .otherwise(0.0)
    )


def components(as_of: Column) -> dict[str, Column]:
    """Unrounded components. Snapshot columns are null when the incident has no impact snapshot."""
    gpu = F.least(F.col("affected_gpu_count") / 10.0, F.lit(24.0))
    power = F.least(F.col("estimated_capacity_risk_kw") / 100.0, F.lit(12.0))
    redundancy = (
        F.when(F.col("redundancy_state") == "N-1", 24.0)
        .when(lost_redundancy(), 18.0)
        .when(F.col("redundancy_state") == "N", 12.0)
        .otherwise(0.0)
    )
    repeats = F.greatest(F.coalesce("asset_incident_count", F.lit(1)) - 1, F.lit(0)) * 8.0
    # Nulls fall out of least(), so a missing value needs its zero before the cap.
    return {
        "asset_criticality_score": lookup("criticality_level", vocab.CRITICALITY_SCORE, 0.0),
        "downtime_score": F.least(F.col("estimated_downtime_hours") * 1.2, F.lit(30.0)),
        "stage_delay_score": F.least(_or_zero(F.col("open_delay_hours")) / 3.0, F.lit(35.0)),
        "infrastructure_zone_impact_score": lookup("zone_priority", vocab.ZONE_SCORE, 0.0),
        "needed_by_urgency_score": urgency(F.col("needed_by_at"), as_of),
        "repeat_failure_score": F.least(repeats, F.lit(16.0)),
        "spare_risk_score": _or_zero(F.col("spare_risk")),
        "capacity_risk_score": F.when(F.col("impact_snapshot_id").isNull(), 0.0).otherwise(
            F.least(gpu + power, F.lit(30.0))
        ),
        "redundancy_risk_score": redundancy,
        "thermal_risk_score": F.least(_or_zero(F.col("thermal_breach_minutes") / 6.0), F.lit(18.0)),
        "vendor_eta_risk_score": vendor_risk(as_of),
        "mitigation_credit_score": lookup("mitigation_status", vocab.MITIGATION_CREDIT, 0.0),
    }


def total_score() -> Column:
    total = F.lit(0.0)
    for name in COMPONENTS[:-1]:
        total = total + F.col(name)
    return total - F.col("mitigation_credit_score")


def recommended_action() -> Column:
    stage = F.col("current_stage")
    waiting = (
        F.when(F.col("vendor_status") == "ETA_MISSED", "Escalate missed vendor ETA and confirm recovery path")
        .when(F.col("needs_out_of_stock_spare"), "Expedite critical spare or vendor dispatch")
        .otherwise("Confirm spare availability or vendor ETA")
    )
    return (
        F.when(stage == "FACILITIES_TRIAGE", "Complete facilities triage and confirm owning team")
        .when(stage == "ENGINEER_ASSIGNED", "Assign facilities engineer or rebalance team")
        .when(stage == "SPARE_VENDOR_WAITING", waiting)
        .when(stage == "REPAIR_IN_PROGRESS", "Unblock repair completion and confirm mitigation status")
        .when(stage == "VALIDATION", "Prioritize restore validation")
        .otherwise("Review infrastructure incident status")
    )


def impact_rationale() -> Column:
    """Sentence on the impact snapshot; empty without a snapshot or without anything to say."""
    gpu, kw = F.col("affected_gpu_count"), F.col("estimated_capacity_risk_kw")
    vendor, mitigation = F.col("vendor_status"), F.col("mitigation_status")
    minutes = F.col("thermal_breach_minutes")
    details = F.concat_ws(
        "; ",
        F.when((gpu != 0) | (kw != 0), F.format_string("%d affected GPUs and %.0f kW at risk", gpu, round_even(kw))),
        F.when(
            (F.col("redundancy_state") == "N-1") | lost_redundancy(),
            F.concat("redundancy_state", F.lit(" redundancy exposure")),
        ),
        F.when(minutes != 0, F.format_string("%d thermal breach minutes", minutes)),
        F.when(~vendor.isin("NOT_REQUIRED", "ETA_CONFIRMED"), F.concat(F.lit("vendor status "), vendor)),
        F.when(mitigation != "NONE", F.concat(F.lit("mitigation "), mitigation)),
    )
    return F.when(details == "", "").otherwise(F.concat(F.lit(" Impact rationale: "), details, F.lit(".")))


def reason_summary() -> Column:
    delayed = F.concat(
        F.col("criticality_level"),
        F.lit(" asset in "),
        F.col("zone_name"),
        F.lit(" is delayed in "),
        F.col("current_stage"),
        F.lit(" for "),
        F.format_string("%.1f", round_even("hours_in_current_stage", 1)),
        F.lit(" hours."),
    )
    waiting = F.concat(
        F.col("criticality_level"),
        F.lit(" infrastructure incident is in "),
        F.col("current_stage"),
        F.lit(" and needed by "),
        iso_text("needed_by_at"),
        F.lit("."),
    )
    return F.concat(F.when(F.col("is_delayed"), delayed).otherwise(waiting), impact_rationale())


def impact_confidence(snapshot_id: Column, open_impact_issues: Column) -> Column:
    return (
        F.when(snapshot_id.isNull(), "UNVERIFIED")
        .when(F.coalesce(open_impact_issues, F.lit(0)) > 0, "WARNING")
        .otherwise("TRUSTED")
    )


def high_impact() -> Column:
    return F.coalesce(F.col("priority_level").isin("CRITICAL", "HIGH"), F.lit(False)) | F.coalesce(
        F.upper("business_impact").rlike(vocab.HIGH_IMPACT_PATTERN), F.lit(False)
    )
