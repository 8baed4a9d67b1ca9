"""Read-side queries over core, analytics and run-scoped tables. Every function returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import vocab
from faultline.functions import scoring
from faultline.functions.scalar import actual_or_estimated, is_active, lookup, round_even, title_case
from faultline.operators.skew import spread_nulls
from faultline.operators.workflow import latest_snapshots

# --- runs and checks -----------------------------------------------------------------------------


def latest_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.asc("pipeline_run_id")).limit(limit)


def latest_run_id(runs: DataFrame) -> Column:
    """Id of the newest run as a scalar subquery; null when there is none."""
    return runs.agg(
        F.min_by("pipeline_run_id", F.struct(-F.unix_micros(F.col("started_at").cast("timestamp")), "pipeline_run_id"))
    ).scalar()


def quality_check_list(
    checks: DataFrame,
    runs: DataFrame,
    run_id: str | None = None,
    status: str | None = None,
    all_runs: bool = False,
    limit: int = 100,
) -> DataFrame:
    """The latest run's checks by default, a given run's, or all runs'."""
    if run_id is not None:
        checks = checks.where(F.col("pipeline_run_id") == run_id)
    elif not all_runs:
        checks = checks.where(F.col("pipeline_run_id") == latest_run_id(runs))
    if status is not None:
        checks = checks.where(F.col("status") == status)
    newest = F.desc("created_at") if "created_at" in checks.columns else F.desc("pipeline_run_id")
    return checks.orderBy(newest, F.asc("check_result_id")).limit(limit)


def quality_check(checks: DataFrame, check_result_id: str) -> DataFrame:
    return checks.where(F.col("check_result_id") == check_result_id)


def failed_check_count(checks: DataFrame, runs: DataFrame) -> DataFrame:
    latest = checks.where(F.col("pipeline_run_id") == latest_run_id(runs))
    return latest.agg(F.count_if(F.col("status") != "PASS").alias("failed_check_count"))


# --- issue flags -----------------------------------------------------------------------------------


def open_issues(issues: DataFrame, runs: DataFrame | None, impact: bool) -> DataFrame:
    if runs is not None:
        issues = issues.where(F.col("pipeline_run_id") == latest_run_id(runs))
    wanted = F.col("issue_type").isin(vocab.IMPACT_ISSUES)
    opened = issues.where(wanted if impact else ~wanted).where(F.col("incident_id").isNotNull())
    return opened.where(F.col("status") == "OPEN") if "status" in issues.columns else opened


def impact_trust_flags(issues: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Open impact issues per incident, in long form."""
    return open_issues(issues, runs, impact=True).select(
        "incident_id", "issue_type", "severity", "message", "evidence_json"
    )


def impact_issue_counts(issues: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    flags = open_issues(issues, runs, impact=True)
    return flags.groupBy("incident_id").agg(F.count(F.lit(1)).alias("impact_trust_issue_count"))


def issue_label() -> Column:
    return lookup("issue_type", vocab.ISSUE_LABELS, vocab.DEFAULT_ISSUE_LABEL)


def quality_flags(
    incidents: DataFrame, checks: DataFrame, issues: DataFrame, runs: DataFrame | None = None
) -> DataFrame:
    """Flags of every incident in long form: failed checks whose sample keys contain its id, then its open issues.

    A run has at most 41 checks of 10 sample keys, so all substrings of those keys are few. They turn the "contains"
    test into an equality join on the incident id.
    """
    if runs is not None:
        checks = checks.where(F.col("pipeline_run_id") == latest_run_id(runs))
    text = F.concat("target_table", F.lit("."), "check_name", F.lit(": "), "message")
    keys = checks.where(F.col("status") != "PASS").select(
        text.alias("flag"), "check_result_id", F.explode("sample_failed_keys").alias("key")
    )
    starts = keys.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("key"))))
    pieces = starts.select(
        "flag",
        "check_result_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("key") - F.col("start") + 1),
                lambda size: F.substring(F.col("key"), F.col("start"), size),
            )
        ).alias("incident_id"),
    ).distinct()
    from_checks = incidents.select("incident_id").join(pieces, "incident_id").select(
        "incident_id", F.lit(1).alias("flag_source"), F.col("check_result_id").alias("sort_key"), "flag"
    )
    from_issues = open_issues(issues, runs, impact=False).select(
        "incident_id",
        F.lit(2).alias("flag_source"),
        F.concat_ws(" ", "severity", "issue_type").alias("sort_key"),
        F.concat(issue_label(), F.lit(": "), "message").alias("flag"),
    )
    return from_checks.unionByName(from_issues.join(incidents.select("incident_id"), "incident_id", "left_semi"))


# --- follow-ups ------------------------------------------------------------------------------------

SNAPSHOT_VIEW = [
    "redundancy_state",
    "affected_gpu_count",
    "estimated_capacity_risk_kw",
    "mitigation_status",
    "vendor_status",
]


def follow_up_rows(
    queue: DataFrame,
    incidents: DataFrame,
    assets: DataFrame,
    zones: DataFrame,
    status: DataFrame,
    snapshots: DataFrame,
    issue_counts: DataFrame,
) -> DataFrame:
    """Queue rows with incident, asset, zone, status, latest snapshot (equal times: largest id) and trust."""
    latest = latest_snapshots(snapshots, "desc").select("incident_id", "impact_snapshot_id", *SNAPSHOT_VIEW)
    rows = (
        queue.drop("current_stage")
        .join(
            incidents.select(
                "incident_id",
                "request_number",
                "request_title",
                "current_stage",
                "current_status",
                "needed_by_at",
                "priority_level",
                "business_impact",
            ),
            "incident_id",
        )
        .join(status.select("incident_id", "hours_in_current_stage", "is_delayed"), "incident_id")
        .join(assets.select("asset_id", "asset_name", "criticality_level"), "asset_id")
        .join(zones.select("zone_id", "zone_name"), "zone_id")
        .join(latest, "incident_id", "left")
        .join(issue_counts, "incident_id", "left")
    )
    return rows.withColumns(
        {
            "affected_gpu_count": F.coalesce("affected_gpu_count", F.lit(0)),
            "estimated_capacity_risk_kw": F.coalesce("estimated_capacity_risk_kw", F.lit(0.0)),
            "impact_trust_issue_count": F.coalesce("impact_trust_issue_count", F.lit(0)).cast("bigint"),
            "impact_confidence_status": scoring.impact_confidence(
                F.col("impact_snapshot_id"), F.col("impact_trust_issue_count")
            ),
        }
    ).drop("impact_snapshot_id")


def filter_follow_ups(
    rows: DataFrame,
    zone_id: str | None = None,
    asset_id: str | None = None,
    priority_level: str | None = None,
    stage: str | None = None,
    delayed_only: bool = False,
    critical_asset_delayed: bool = False,
    capacity_risk: bool = False,
    affected_gpu: bool = False,
    evidence_review: bool = False,
    redundancy_lost: bool = False,
    vendor_eta_missed: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Conjunctive filters, then rank order, then the limit: a top-k over the filtered rows."""
    exact = {"zone_id": zone_id, "asset_id": asset_id, "priority_level": priority_level, "current_stage": stage}
    for column, value in exact.items():
        if value:
            rows = rows.where(F.col(column) == value)
    switches = [
        (delayed_only or critical_asset_delayed, F.col("is_delayed")),
        (critical_asset_delayed, F.col("criticality_level") == "CRITICAL"),
        (capacity_risk, F.col("estimated_capacity_risk_kw") > 0),
        (affected_gpu, F.col("affected_gpu_count") > 0),
        (evidence_review, F.col("impact_confidence_status").isin("WARNING", "UNVERIFIED")),
        (redundancy_lost, F.col("redundancy_state") == "N-1"),
        (vendor_eta_missed, F.col("vendor_status") == "ETA_MISSED"),
    ]
    for wanted, condition in switches:
        if wanted:
            rows = rows.where(condition)
    return rows if limit is None else rows.orderBy("priority_rank").limit(limit)


# --- fixed values: named scopes of the queue ---
QUEUE_SCOPES = {
    "all": {},
    "critical-asset-delay": {"critical_asset_delayed": True},
    "vendor-eta-missed": {"vendor_eta_missed": True},
    "spare-vendor-wait": {"stage": "SPARE_VENDOR_WAITING"},
    "evidence-review": {"evidence_review": True},
    "n-1-exposure": {"redundancy_lost": True},
}


def scope_conditions() -> dict[str, Column]:
    """The named scopes as predicates, so that one pass can count all of them."""
    return {
        "all": F.lit(True),
        "critical-asset-delay": F.col("is_delayed") & (F.col("criticality_level") == "CRITICAL"),
        "vendor-eta-missed": F.col("vendor_status") == "ETA_MISSED",
        "spare-vendor-wait": F.col("current_stage") == "SPARE_VENDOR_WAITING",
        "evidence-review": F.col("impact_confidence_status") != "TRUSTED",
        "n-1-exposure": F.col("redundancy_state") == "N-1",
    }


def scope_sizes(rows: DataFrame) -> DataFrame:
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in scope_conditions().items()]
    wide = rows.agg(*counts)
    return wide.unpivot([], wide.columns, "scope", "queue_items")


def queue_summary(rows: DataFrame) -> DataFrame:
    """Ten figures on a (filtered) queue, the stage that blocks it most and its main risk."""
    spare = F.col("current_stage") == "SPARE_VENDOR_WAITING"
    hours = F.col("hours_in_current_stage")
    stages = rows.groupBy("current_stage").agg(
        F.count(F.lit(1)).alias("queue_items"),
        F.sum(hours).alias("hours"),
        F.count_if(hours > 0).alias("delayed_items"),
        F.count_if(F.col("priority_level") == "CRITICAL").alias("critical_priority_items"),
        F.sum("estimated_capacity_risk_kw").alias("capacity_risk_kw"),
        F.sum("affected_gpu_count").alias("affected_gpu_count"),
        F.count_if(F.col("redundancy_state") == "N-1").alias("n1_exposure_items"),
        F.count_if(F.col("vendor_status") == "ETA_MISSED").alias("vendor_eta_missed_items"),
        F.count_if(F.col("impact_confidence_status") != "TRUSTED").alias("evidence_review_items"),
    )

    def total(name: str, when: Column | None = None) -> Column:
        value = F.col(name) if when is None else F.when(when, F.col(name))
        zero = F.lit(0.0) if name in ("hours", "capacity_risk_kw") else F.lit(0)
        return F.coalesce(F.sum(value), zero)

    summary = stages.agg(
        *[
            total(name).alias(name)
            for name in (
                "queue_items",
                "delayed_items",
                "critical_priority_items",
                "capacity_risk_kw",
                "affected_gpu_count",
                "n1_exposure_items",
                "vendor_eta_missed_items",
            )
        ],
        total("queue_items", spare).alias("spare_vendor_wait_items"),
        total("hours", spare).alias("spare_vendor_wait_hours"),
        total("evidence_review_items").alias("evidence_review_items"),
        F.min_by("current_stage", F.struct(-F.col("hours"), -F.col("queue_items"), "current_stage")).alias("_top"),
    )
    n1, missed = F.col("n1_exposure_items") > 0, F.col("vendor_eta_missed_items") > 0
    risk = (
        F.when(F.col("queue_items") == 0, "No active risk")
        .when(n1 & missed, "N-1 + missed ETA")
        .when(n1, "N-1 exposure")
        .when(missed, "Vendor ETA missed")
        .when(F.col("spare_vendor_wait_items") > 0, "Spare/vendor wait")
        .otherwise("Delay queue")
    )
    return summary.withColumns(
        {"top_blocker": F.coalesce(title_case("_top"), F.lit("No blocker")), "primary_risk": risk}
    ).drop("_top")


# --- incident detail ---------------------------------------------------------------------------------


def incident_headers(
    incidents: DataFrame,
    assets: DataFrame,
    zones: DataFrame,
    status: DataFrame,
    queue: DataFrame,
    snapshots: DataFrame,
    issue_counts: DataFrame,
) -> DataFrame:
    """Follow-up row of any incident; one outside the queue gets rank 0, zero scores and a status sentence."""
    base = incidents.join(status.select("incident_id"), "incident_id", "left_semi").select(
        "incident_id", "asset_id", "zone_id", "current_stage", "current_status"
    )
    idle_action = F.when(is_active(), "Review infrastructure incident status").otherwise("No follow-up required")
    idle_reason = F.concat(
        F.lit("Incident is "), "current_status", F.lit(" in "), "current_stage", F.lit(".")
    )
    zeros = {name: 0.0 for name in [*scoring.COMPONENTS, "total_priority_score"]}
    filled = base.join(queue.drop("asset_id", "zone_id", "current_stage"), "incident_id", "left").withColumns(
        {
            "priority_rank": F.coalesce("priority_rank", F.lit(0)).cast("bigint"),
            **{name: F.coalesce(name, F.lit(value)) for name, value in zeros.items()},
            "recommended_action": F.coalesce("recommended_action", idle_action),
            "reason_summary": F.coalesce("reason_summary", idle_reason),
        }
    )
    return follow_up_rows(
        filled.drop("current_status"), incidents, assets, zones, status, snapshots, issue_counts
    )


def timeline(events: DataFrame, incident_id: str | None = None) -> DataFrame:
    if incident_id is not None:
        events = events.where(F.col("incident_id") == incident_id).orderBy("occurred_at", "event_id")
    return events.select(
        "incident_id",
        "event_id",
        "stage",
        "event_type",
        "event_status",
        "occurred_at",
        "actor_type",
        "reason_code",
        F.get_json_object("metadata_json", "$.message").alias("message"),
    )


def work_orders_with_spares(work_orders: DataFrame, spares: DataFrame) -> DataFrame:
    named = spares.select(
        F.col("spare_id").alias("_spare"),
        F.col("spare_name").alias("required_spare_name"),
        "stock_status",
    )
    key = spread_nulls(F.col("required_spare_id"), "work_order_id")
    return work_orders.join(named, key == F.col("_spare"), "left").drop("_spare")


def incident_detail(
    incident_id: str,
    core: dict[str, DataFrame],
    analytics: dict[str, DataFrame],
    checks: DataFrame,
    issues: DataFrame,
    runs: DataFrame,
) -> dict[str, DataFrame]:
    """The sections of one incident's detail. Each stays a table, so no incident is too large for a row."""

    def of(df: DataFrame, *order: str, column: str = "incident_id") -> DataFrame:
        rows = df.where(F.col(column) == incident_id)
        return rows.orderBy(*order) if order else rows

    counts = impact_issue_counts(issues, runs)
    header = incident_headers(
        of(core["incidents"]),
        core["assets"],
        core["zones"],
        analytics["current_status"],
        analytics["follow_up_queue"],
        of(core["snapshots"]),
        counts,
    )
    return {
        "header": header,
        "stage_lead_times": of(analytics["stage_lead_times"], "entered_at"),
        "timeline": timeline(core["events"], incident_id),
        "work_orders": work_orders_with_spares(of(core["work_orders"]), core["spares"]).orderBy("work_order_id"),
        "validations": of(core["validations"], "validation_id"),
        "alerts": of(core["alerts"], "telemetry_alert_id", column="linked_incident_id"),
        "impact_snapshot": latest_snapshots(of(core["snapshots"]), "asc"),
        "quality_flags": quality_flags(of(core["incidents"]), checks, of(issues), runs).orderBy(
            "flag_source", "sort_key"
        ),
        "impact_trust_flags": impact_trust_flags(of(issues), runs).orderBy("severity", "issue_type"),
    }


def validation_status_summary(incidents: DataFrame, validations: DataFrame) -> DataFrame:
    """"2 Passed / 1 Failed" per incident, for incidents without any as well."""
    counts = validations.groupBy("incident_id", "validation_status").agg(F.count(F.lit(1)).alias("n"))
    part = F.concat_ws(" ", F.col("n").cast("string"), title_case("validation_status"))
    ordered = F.sort_array(F.collect_list(F.struct("validation_status", part.alias("text"))))
    texts = counts.groupBy("incident_id").agg(F.concat_ws(" / ", F.transform(ordered, lambda r: r["text"])).alias("text"))
    return incidents.select("incident_id").join(texts, "incident_id", "left").select(
        "incident_id", F.coalesce("text", F.lit("No validation records")).alias("validation_summary")
    )


# --- overview, summaries and lists --------------------------------------------------------------------


def _lost() -> Column:
    return (
        F.col("power_redundancy_lost") | F.col("cooling_redundancy_lost") | (F.col("redundancy_state") == "N-1")
    )


def _active_latest(incidents: DataFrame, snapshots: DataFrame) -> DataFrame:
    active = incidents.where(is_active()).select("incident_id")
    return latest_snapshots(snapshots, "asc").join(active, "incident_id", "left_semi")


def _sum0(value: str | Column, places: int | None = None) -> Column:
    if places is None:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")
    return round_even(F.coalesce(F.sum(value), F.lit(0.0)), places)


def overview(
    incidents: DataFrame,
    assets: DataFrame,
    snapshots: DataFrame,
    status: DataFrame,
    bottlenecks: DataFrame,
    asset_delays: DataFrame,
    spare_waits: DataFrame,
    checks: DataFrame,
    runs: DataFrame,
) -> DataFrame:
    """Fifteen figures in one row: one-row aggregates side by side."""
    counts = incidents.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(is_active()).alias("open_requests"),
        round_even(F.coalesce(F.avg(actual_or_estimated()), F.lit(0.0)), 2).alias("avg_downtime_hours"),
    )
    critical = assets.select("asset_id", "criticality_level")
    late = (
        status.where("is_delayed")
        .join(critical, "asset_id", "left")
        .agg(
            F.count(F.lit(1)).alias("delayed_requests"),
            F.count_if(F.col("criticality_level") == "CRITICAL").alias("critical_asset_delayed"),
        )
    )
    stage_rows = bottlenecks.where(F.col("dimension_type") == "STAGE")
    stages = stage_rows.agg(
        F.min_by("stage", F.struct(-F.col("total_delay_hours"), "stage")).alias("top_bottleneck_stage"),
        _sum0(F.when(F.col("stage") == "ENGINEER_ASSIGNED", F.col("total_delay_hours")), 2).alias(
            "engineer_assignment_delay_hours"
        ),
    )
    waits = spare_waits.agg(_sum0("total_wait_hours", 2).alias("spare_waiting_delay_hours"))
    repeats = asset_delays.agg(F.count_if(F.col("repeat_failure_count") > 0).alias("repeat_failure_asset_count"))
    impact = _active_latest(incidents, snapshots).agg(
        _sum0("estimated_capacity_risk_kw", 2).alias("capacity_risk_kw"),
        _sum0("affected_gpu_count").alias("affected_gpu_count"),
        F.count_if(_lost()).alias("redundancy_lost_incidents"),
        F.count_if(F.col("vendor_status") == "ETA_MISSED").alias("vendor_eta_missed_count"),
    )
    latest_status = runs.agg(
        F.min_by("status", F.struct(-F.unix_micros(F.col("started_at").cast("timestamp")), "pipeline_run_id")).alias(
            "latest_pipeline_run_status"
        )
    )
    quality = failed_check_count(checks, runs).select(
        F.when(F.col("failed_check_count") > 0, "FAILED").otherwise("PASS").alias("data_quality_status")
    )
    row = counts
    for part in (late, stages, waits, repeats, impact, latest_status, quality):
        row = row.crossJoin(part)  # every side is a global aggregate: exactly one row
    return row


def impact_summary(incidents: DataFrame, snapshots: DataFrame, issue_counts: DataFrame) -> DataFrame:
    """Eleven figures over the latest snapshots of active incidents."""
    active = incidents.where(is_active())
    rows = active.select("incident_id", "priority_level", "business_impact").join(
        latest_snapshots(snapshots, "asc").drop("asset_id", "zone_id"), "incident_id", "left"
    ).join(issue_counts, "incident_id", "left")
    has = F.col("impact_snapshot_id").isNotNull()
    judged = has | F.col("impact_trust_issue_count").isNotNull() | scoring.high_impact()
    confidence = scoring.impact_confidence(F.col("impact_snapshot_id"), F.col("impact_trust_issue_count"))
    return rows.agg(
        F.count_if(has).alias("incident_count"),
        _sum0("estimated_capacity_risk_kw", 2).alias("capacity_risk_kw"),
        _sum0("affected_rack_count").alias("affected_rack_count"),
        _sum0("affected_gpu_count").alias("affected_gpu_count"),
        F.count_if(_lost()).alias("redundancy_lost_incidents"),
        F.count_if(F.col("vendor_status") == "ETA_MISSED").alias("vendor_eta_missed_count"),
        F.count_if(F.col("mitigation_status") != "NONE").alias("mitigated_incidents"),
        _sum0("thermal_breach_minutes").alias("thermal_breach_minutes"),
        F.count_if(judged & (confidence == "TRUSTED")).alias("trusted_impact_count"),
        F.count_if(judged & (confidence == "WARNING")).alias("warning_impact_count"),
        F.count_if(judged & (confidence == "UNVERIFIED")).alias("unverified_impact_count"),
    )


def stage_downtime(bottlenecks: DataFrame, stage: str | None = None) -> DataFrame:
    rows = bottlenecks.where(F.col("dimension_type") == "STAGE")
    if stage:
        rows = rows.where(F.col("stage") == stage)
    return rows.select(
        "stage",
        "request_count",
        "delayed_count",
        "delay_rate",
        "avg_duration_hours",
        "p90_duration_hours",
        "total_delay_hours",
    ).orderBy(F.desc("total_delay_hours"), F.asc("stage"))


def worst_assets(asset_delays: DataFrame, limit: int = 20) -> DataFrame:
    return asset_delays.orderBy(F.desc("total_downtime_hours"), F.asc("asset_name")).limit(limit)


def worst_zones(zone_delays: DataFrame) -> DataFrame:
    return zone_delays.orderBy(F.desc("total_downtime_hours"), F.asc("zone_name"))


def longest_spare_waits(spare_waits: DataFrame) -> DataFrame:
    return spare_waits.orderBy(F.desc("total_wait_hours"), F.asc("spare_name"))


def active_incidents_per_asset(incidents: DataFrame) -> DataFrame:
    return incidents.where(is_active()).groupBy("asset_id").agg(F.count(F.lit(1)).alias("active_incident_count"))


def topology(
    dependencies: DataFrame,
    assets: DataFrame,
    incidents: DataFrame,
    asset_id: str | None = None,
    dependency_type: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Edges with both assets and their active incident counts."""
    if dependency_type:
        dependencies = dependencies.where(F.col("dependency_type") == dependency_type)
    if asset_id:
        dependencies = dependencies.where(
            (F.col("dependent_asset_id") == asset_id) | (F.col("dependency_asset_id") == asset_id)
        )
    counted = assets.select("asset_id", "asset_name", "asset_type", "current_status").join(
        active_incidents_per_asset(incidents), "asset_id", "left"
    )

    def side(name: str) -> DataFrame:
        return counted.select(
            F.col("asset_id").alias(f"{name}_asset_id"),
            F.col("asset_name").alias(f"{name}_asset_name"),
            F.col("asset_type").alias(f"{name}_asset_type"),
            F.col("current_status").alias(f"{name}_status"),
            F.coalesce("active_incident_count", F.lit(0)).alias(f"{name}_active_incident_count"),
        )

    rows = (
        dependencies.drop("source_system", "metadata_json")
        .join(side("dependent"), "dependent_asset_id")
        .join(side("dependency"), "dependency_asset_id")
    )
    if limit is None:
        return rows
    return rows.orderBy("dependency_type", "dependent_asset_id", "dependency_asset_id").limit(limit)


def filter_metadata(
    zones: DataFrame,
    assets: DataFrame,
    work_orders: DataFrame,
    spares: DataFrame,
    incidents: DataFrame,
    queue: DataFrame,
) -> DataFrame:
    """Distinct values of the nine filter lists in long form (list, value, name)."""

    def values(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(F.col(column).alias("value")).distinct().select(
            F.lit(name).alias("list"), "value", F.lit(None).cast("string").alias("name")
        )

    parts = [
        zones.select(F.lit("infrastructure_zones").alias("list"), F.col("zone_id").alias("value"),
                     F.col("zone_name").alias("name")),
        assets.select(F.lit("assets").alias("list"), F.col("asset_id").alias("value"),
                      F.col("asset_name").alias("name")),
        values(assets, "asset_type", "asset_types"),
        values(work_orders, "assigned_team", "facilities_teams"),
        values(spares, "spare_category", "spare_categories"),
        values(incidents, "priority_level", "priority_levels"),
        values(incidents, "request_type", "request_types"),
        values(incidents, "failure_mode", "failure_modes"),
        values(queue, "current_stage", "stages"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- display bands ---------------------------------------------------------------------------------------


def impact_tones(snapshots: DataFrame) -> DataFrame:
    """Display bands of each snapshot; null means no emphasis."""
    kw, pct = F.col("estimated_capacity_risk_kw"), F.col("estimated_gpu_capacity_risk_pct")
    vendor = F.col("vendor_status")
    return snapshots.select(
        "impact_snapshot_id",
        F.when(kw <= 0, None).when((kw >= 500) | (pct >= 25), "danger").otherwise("warning").alias("capacity_tone"),
        lookup("redundancy_state", {"N-1": "danger", "N": "warning"}).alias("redundancy_tone"),
        F.when(vendor == "ETA_MISSED", "danger")
        .when(vendor == "WAITING_VENDOR_DISPATCH", "warning")
        .alias("vendor_tone"),
        F.when(F.col("mitigation_status").isin("RUNNING_DEGRADED", "LOAD_SHIFTED"), "warning").alias(
            "mitigation_tone"
        ),
    )


def reading_tones(snapshots: DataFrame) -> DataFrame:
    """One row per telemetry reading with its band."""
    status = F.upper("r.status")
    return snapshots.select("impact_snapshot_id", F.explode("telemetry_readings").alias("r")).select(
        "impact_snapshot_id",
        "r.*",
        F.when(status.rlike("CRITICAL|ALARM|BREACH|FAILED"), "danger")
        .when(status.rlike("WARNING|DEGRADED|AT_RISK"), "warning")
        .alias("telemetry_tone"),
    )
