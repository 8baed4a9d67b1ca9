"""Vocabulary and workflow validators. Each returns rows of the common issue schema."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import vocab
from faultline.functions.scalar import explode_present, is_active, json_object, lookup, one_of
from faultline.operators.skew import HOT_ROWS, chunk_hot_keys, ends

PREFIX = "workflow_ontology_"


def issue(
    kind: str,
    message: str | Column,
    evidence: Column,
    incident: str | Column | None = "incident_id",
    asset: str | Column | None = None,
    severity: str = "ERROR",
) -> Column:
    def text(value: str | Column | None) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        return F.col(value) if isinstance(value, str) else value

    return F.struct(
        text(incident).alias("incident_id"),
        text(asset).alias("asset_id"),
        F.lit(kind).alias("issue_type"),
        F.lit(severity).alias("severity"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        evidence.alias("evidence_json"),
    )


def emit(df: DataFrame, *cases: tuple[Column, Column]) -> DataFrame:
    """One output row per case whose condition holds; a row may give several. No shuffle."""
    found = [F.when(condition, row) for condition, row in cases]
    some = reduce(or_, [condition for condition, _ in cases])  # most rows give nothing and need no array
    return explode_present(df.where(some), found, "found").select("found.*")


def _outside(
    column: str, allowed: list[str], kind: str, message: str, keys: list[str], incident=None, asset=None
) -> tuple[Column, Column]:
    evidence = json_object(**{name: name for name in [*keys, column]})
    return ~one_of(column, allowed), issue(PREFIX + kind, message, evidence, incident, asset)


def incident_vocabulary(incidents: DataFrame) -> DataFrame:
    def case(column: str, allowed: list[str], kind: str, noun: str) -> tuple[Column, Column]:
        message = f"The incident {noun} is not part of the workflow ontology."
        return _outside(column, allowed, kind, message, [], "incident_id", "asset_id")

    return emit(
        incidents,
        case("current_stage", vocab.STAGES, "invalid_stage", "current stage"),
        case("current_status", vocab.INCIDENT_STATUSES, "invalid_status", "current status"),
        case("priority_level", vocab.LEVELS, "invalid_priority", "priority level"),
    )


def event_vocabulary(events: DataFrame) -> DataFrame:
    def case(column: str, allowed: list[str], kind: str, noun: str) -> tuple[Column, Column]:
        message = f"A stage event uses {noun} that is not part of the workflow ontology."
        return _outside(column, allowed, kind, message, ["event_id"], "incident_id")

    return emit(
        events,
        case("stage", vocab.STAGES, "invalid_stage", "a stage"),
        case("event_type", vocab.EVENT_TYPES, "invalid_event_type", "an event type"),
        case("event_status", vocab.EVENT_STATUSES, "invalid_event_status", "an event status"),
    )


def impact_vocabulary(snapshots: DataFrame, incidents: DataFrame) -> DataFrame:
    """The asset of an issue is the incident's asset, not the one written on the snapshot."""
    owned = snapshots.drop("asset_id").join(incidents.select("incident_id", "asset_id"), "incident_id", "left")

    def case(column: str, allowed: list[str], kind: str, noun: str) -> tuple[Column, Column]:
        message = f"The impact snapshot {noun} is not part of the workflow ontology."
        return _outside(column, allowed, kind, message, ["impact_snapshot_id"], "incident_id", "asset_id")

    return emit(
        owned,
        case("redundancy_state", vocab.REDUNDANCY_STATES, "invalid_redundancy_state", "redundancy state"),
        case("mitigation_status", vocab.MITIGATIONS, "invalid_mitigation_status", "mitigation status"),
        case("vendor_status", vocab.VENDOR_STATUSES, "invalid_vendor_status", "vendor status"),
    )


def zone_vocabulary(zones: DataFrame) -> DataFrame:
    text = "The infrastructure zone {} is not part of the workflow ontology."
    return emit(
        zones,
        _outside("zone_priority", vocab.LEVELS, "invalid_zone_priority", text.format("priority"), ["zone_id"]),
        _outside(
            "current_status", vocab.OPERATIONAL_STATUSES, "invalid_zone_status", text.format("status"), ["zone_id"]
        ),
    )


def asset_vocabulary(assets: DataFrame) -> DataFrame:
    def case(column: str, allowed: list[str], kind: str, noun: str) -> tuple[Column, Column]:
        message = f"The infrastructure asset {noun} is not part of the workflow ontology."
        return _outside(column, allowed, kind, message, ["asset_id"], None, "asset_id")

    return emit(
        assets,
        case("criticality_level", vocab.LEVELS, "invalid_asset_criticality", "criticality"),
        case("current_status", vocab.OPERATIONAL_STATUSES, "invalid_asset_status", "status"),
    )


def dependency_vocabulary(dependencies: DataFrame, assets: DataFrame) -> DataFrame:
    known = assets.select("asset_id").distinct()
    flagged = dependencies.join(
        known.select(F.col("asset_id").alias("dependent_asset_id"), F.lit(True).alias("_dependent")),
        "dependent_asset_id",
        "left",
    ).join(
        known.select(F.col("asset_id").alias("dependency_asset_id"), F.lit(True).alias("_dependency")),
        "dependency_asset_id",
        "left",
    )
    by_id = json_object(dependency_id="dependency_id")
    inventory = "The {} asset is not part of the infrastructure asset inventory."

    def case(column: str, allowed: list[str], kind: str, noun: str) -> tuple[Column, Column]:
        message = f"The infrastructure dependency {noun} is not part of the workflow ontology."
        return _outside(column, allowed, kind, message, ["dependency_id"], None, "dependent_asset_id")

    return emit(
        flagged,
        (
            F.col("dependent_asset_id") == F.col("dependency_asset_id"),
            issue(
                PREFIX + "invalid_dependency_edge",
                "An infrastructure dependency cannot point an asset at itself.",
                by_id,
                None,
                "dependent_asset_id",
            ),
        ),
        (
            F.col("_dependent").isNull(),
            issue(
                PREFIX + "invalid_dependency_asset", inventory.format("dependent"), by_id, None, "dependent_asset_id"
            ),
        ),
        (
            F.col("_dependency").isNull(),
            issue(
                PREFIX + "invalid_dependency_asset", inventory.format("dependency"), by_id, None, "dependency_asset_id"
            ),
        ),
        case("dependency_type", vocab.DEPENDENCY_TYPES, "invalid_dependency_type", "type"),
        case("dependency_role", vocab.DEPENDENCY_ROLES, "invalid_dependency_role", "role"),
    )


def spare_vocabulary(spares: DataFrame) -> DataFrame:
    message = "The critical spare stock status is not part of the workflow ontology."
    return emit(spares, _outside("stock_status", vocab.STOCK_STATUSES, "invalid_spare_stock_status", message, ["spare_id"]))


def work_order_vocabulary(work_orders: DataFrame) -> DataFrame:
    message = "The facility work order status is not part of the workflow ontology."
    return emit(
        work_orders,
        _outside(
            "work_order_status",
            vocab.WORK_ORDER_STATUSES,
            "invalid_work_order_status",
            message,
            ["work_order_id"],
            "incident_id",
        ),
    )


def validation_vocabulary(validations: DataFrame) -> DataFrame:
    message = "The validation status is not part of the workflow ontology."
    return emit(
        validations,
        _outside(
            "validation_status",
            vocab.VALIDATION_STATUSES,
            "invalid_validation_status",
            message,
            ["validation_id"],
            "incident_id",
        ),
    )


def telemetry_vocabulary(alerts: DataFrame) -> DataFrame:
    message = "The telemetry alert severity is not part of the workflow ontology."
    return emit(
        alerts,
        _outside(
            "severity",
            vocab.SEVERITIES,
            "invalid_telemetry_severity",
            message,
            ["telemetry_alert_id"],
            "linked_incident_id",
        ),
    )


# --- transition rules --------------------------------------------------------------------------


def known_stage_events(events: DataFrame) -> DataFrame:
    return events.where(one_of("stage", vocab.STAGES))


def entered_events(events: DataFrame) -> DataFrame:
    entered = known_stage_events(events).where(F.col("event_type") == vocab.ENTERED)
    return entered.select("incident_id", "event_id", "stage", "occurred_at")


def stage_event_types(events: DataFrame) -> DataFrame:
    """Events whose type is known but not allowed in their stage."""
    anywhere = [vocab.ENTERED, vocab.INCIDENT_RESTORED, *vocab.IMPACT_EVENTS]
    allowed = {
        stage: sorted(
            anywhere
            + ([vocab.EXIT_EVENT[stage]] if stage in vocab.EXIT_EVENT else [])
            + ([vocab.VALIDATION_FAILED] if stage == "VALIDATION" else [])
        )
        for stage in vocab.STAGES
    }
    listing = lookup("stage", allowed)
    misplaced = one_of("event_type", vocab.EVENT_TYPES) & ~F.array_contains(listing, F.col("event_type"))
    evidence = json_object(event_id="event_id", stage="stage", event_type="event_type", allowed_event_types=listing)
    row = issue(
        PREFIX + "invalid_stage_event_type", "A stage event type is not allowed for the event stage.", evidence
    )
    return emit(known_stage_events(events), (misplaced, row))


def duplicate_stage_entries(events: DataFrame) -> DataFrame:
    groups = ends(entered_events(events), ["incident_id", "stage"], ["occurred_at", "event_id"], "event_id")
    row = issue(
        PREFIX + "duplicate_stage_entry",
        "An incident has duplicate entered-stage evidence for a workflow stage.",
        json_object(stage="stage", event_count="n", first_event_id="first", last_event_id="last"),
    )
    return emit(groups, (F.col("n") > 1, row))


def stage_progression(events: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """First entry must be the first stage; every later entry must be the next stage."""
    chunked = chunk_hot_keys(entered_events(events), ["incident_id"], ["occurred_at", "event_id"], hot_rows)
    oldest_first = Window.partitionBy(*chunked.partition_keys).orderBy("occurred_at", "event_id")
    paired = chunked.df.withColumn("prev", F.lag(F.struct("event_id", "stage")).over(oldest_first))
    if chunked.split:
        ends = chunked.df.groupBy(*chunked.partition_keys).agg(
            F.max_by(F.struct("event_id", "stage"), F.struct("occurred_at", "event_id")).alias("_end")
        )
        by_chunk = Window.partitionBy(*chunked.keys).orderBy("chunk")
        borders = ends.select(*chunked.partition_keys, F.lag("_end").over(by_chunk).alias("_before"))
        paired = paired.join(borders, chunked.partition_keys, "left").withColumn("prev", F.coalesce("prev", "_before"))
    place = {stage: number for number, stage in enumerate(vocab.STAGES)}
    previous, current = lookup("prev.stage", place), lookup("stage", place)
    kind = PREFIX + "invalid_stage_progression"
    return emit(
        paired,
        (
            F.col("prev").isNull() & (current != 0),
            issue(
                kind,
                "The incident did not enter the workflow through INCIDENT_REPORTED.",
                json_object(first_entered_stage="stage"),
            ),
        ),
        (
            F.col("prev").isNotNull() & (current != previous + 1),
            issue(
                kind,
                "The incident entered workflow stages out of order or skipped a required stage.",
                json_object(
                    previous_event_id="prev.event_id",
                    previous_stage="prev.stage",
                    current_event_id="event_id",
                    current_stage="stage",
                ),
            ),
        ),
    )


def early_terminal_events(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """Entries of the terminal stage of incidents that are still active."""
    active = incidents.where(is_active()).select("incident_id")
    return entered_events(events).where(F.col("stage") == vocab.RESTORED).join(active, "incident_id", "left_semi")


def restored_state(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """Status and terminal evidence must agree, for incidents with at least one event of a known stage."""
    known = known_stage_events(events)
    entered = F.col("event_type") == vocab.ENTERED
    seen = known.groupBy("incident_id").agg(
        F.sort_array(F.collect_set(F.when(entered, F.col("stage")))).alias("stages"),  # at most seven values
        F.count_if(F.col("event_type") == vocab.INCIDENT_RESTORED).alias("restores"),
    )
    owners = incidents.select("incident_id", "asset_id", "current_status")
    reached = F.array_contains("stages", vocab.RESTORED)
    kind = PREFIX + "invalid_restored_state"
    no_evidence = emit(
        seen.join(owners, "incident_id"),
        (
            ~is_active() & ~reached & (F.col("restores") == 0),
            issue(
                kind,
                "The incident is restored but has no terminal restore evidence.",
                json_object(current_status="current_status", entered_stages="stages", restored_event_count="restores"),
                asset="asset_id",
            ),
        ),
    )
    early = early_terminal_events(events, incidents)
    lists = ends(early, ["incident_id"], ["occurred_at", "event_id"], "event_id")
    still_active = emit(
        lists.join(owners, "incident_id"),
        (
            F.lit(True),
            issue(
                kind,
                "The incident is active but event history entered the terminal RESTORED stage.",
                json_object(
                    current_status="current_status", event_count="n", first_event_id="first", last_event_id="last"
                ),
                asset="asset_id",
            ),
        ),
    )
    return no_evidence.unionByName(still_active)


def transition_rules(events: DataFrame, incidents: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    return (
        stage_event_types(events)
        .unionByName(duplicate_stage_entries(events))
        .unionByName(stage_progression(events, hot_rows))
        .unionByName(restored_state(events, incidents))
    )
