"""The 41 data-quality checks: failing keys in long form first, one result row per check from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import vocab
from faultline.functions.scalar import explode_present, is_iso, truthy
from faultline.operators import validators
from faultline.operators.core import missing_fields, payload_fields
from faultline.operators.raw_load import KEY, has_object_payload
from faultline.operators.skew import HOT_ROWS, first_per_group, spread_nulls
from faultline.session import checkpoint
from faultline.sources.contracts import CORE_TABLE_NAMES, RAW_FEEDS

SAMPLE_KEYS = 10

# --- fixed values: names, targets, severities and messages of the checks, in result order --------------------------
_RAW_CHECKS = [
    ("unknown_source_system", "Source system must match the expected infrastructure sample source."),
    ("duplicate_source_record", "Duplicate source records are rejected before raw insertion."),
    ("missing_required_fields", "Required payload fields must exist before core transformation."),
    ("invalid_date_format", "Date and timestamp fields must be ISO formatted."),
]
_REFERENCE_MESSAGES = [
    ("events", "Infrastructure stage event source records must reference an existing source infrastructure request."),
    ("work_orders", "Infrastructure work order source records must reference an existing source infrastructure "
                    "request."),
    ("validations", "Validation source records must reference an existing source infrastructure request."),
    ("alerts", "Linked telemetry alerts must reference an existing source infrastructure incident when populated."),
]
_CORE_CHECKS = [
    ("infrastructure_incident_without_stage_event", "incidents", "ERROR",
     "Every core infrastructure incident should have at least one stage event."),
    ("stage_event_timestamp_out_of_order", "events", "ERROR",
     "Infrastructure stage event timestamps should not occur before request reporting."),
    ("workflow_ontology_incident_vocabulary", "incidents", "ERROR",
     "Incident stage, status, and priority values must match the workflow ontology vocabulary."),
    ("workflow_ontology_stage_event_vocabulary", "events", "ERROR",
     "Stage event stages, event types, and event statuses must match the workflow ontology vocabulary."),
    ("workflow_ontology_impact_vocabulary", "snapshots", "ERROR",
     "Impact redundancy, mitigation, and vendor states must match the workflow ontology vocabulary."),
    ("workflow_ontology_transition_rules", "events", "ERROR",
     "Stage event history must follow the workflow ontology transition rules."),
    ("workflow_ontology_zone_vocabulary", "zones", "ERROR",
     "Zone priority and operational status values must match the workflow ontology vocabulary."),
    ("workflow_ontology_asset_vocabulary", "assets", "ERROR",
     "Asset criticality and operational status values must match the workflow ontology vocabulary."),
    ("workflow_ontology_dependency_vocabulary", "dependencies", "ERROR",
     "Infrastructure topology dependency edges must reference known assets and use allowed type and role values."),
    ("workflow_ontology_spare_vocabulary", "spares", "ERROR",
     "Critical spare stock status values must match the workflow ontology vocabulary."),
    ("workflow_ontology_work_order_vocabulary", "work_orders", "ERROR",
     "Facility work order status values must match the workflow ontology vocabulary."),
    ("workflow_ontology_validation_vocabulary", "validations", "ERROR",
     "Validation status values must match the workflow ontology vocabulary."),
    ("workflow_ontology_telemetry_vocabulary", "alerts", "ERROR",
     "Telemetry severity values must match the workflow ontology vocabulary."),
    ("work_order_without_request", "work_orders", "CRITICAL",
     "Every infrastructure work order should reference an existing core infrastructure request."),
    ("validation_without_completed_work", "validations", "ERROR",
     "Validation records should only exist after infrastructure work is completed."),
    ("spare_waiting_without_required_spare", "work_orders", "ERROR",
     "Work orders waiting on a spare or vendor should identify the required spare when applicable."),
    ("telemetry_alert_without_known_asset", "alerts", "ERROR",
     "Telemetry alerts should reference known infrastructure assets."),
]

CHECKS = (
    [(name, feed.target_table, "ERROR", message) for feed in RAW_FEEDS for name, message in _RAW_CHECKS]
    + [
        ("missing_infrastructure_request_reference", feed.target_table, "ERROR", message)
        for core, message in _REFERENCE_MESSAGES
        for feed in RAW_FEEDS
        if feed.core == core
    ]
    + [(name, CORE_TABLE_NAMES[core], severity, message) for name, core, severity, message in _CORE_CHECKS]
)
RAW_CHECK_COUNT = len(RAW_FEEDS) * len(_RAW_CHECKS) + len(_REFERENCE_MESSAGES)


def check_number(name: str, table: str) -> int:
    return next(i for i, check in enumerate(CHECKS, start=1) if check[0] == name and check[1] == table)


def _failures(df: DataFrame, number: int | Column, key: Column, rows: Column | None = None) -> DataFrame:
    count = F.lit(1).cast("bigint") if rows is None else rows.cast("bigint")
    number = F.lit(number) if isinstance(number, int) else number
    return df.select(number.alias("check_number"), key.alias("failed_key"), count.alias("failed_rows"))


def record_key() -> Column:
    return F.concat_ws(":", F.coalesce(KEY[0], F.lit("None")), F.coalesce(KEY[1], F.lit("None")))


def raw_failures(raw: dict[str, DataFrame], source_system: str = vocab.SOURCE_SYSTEM) -> DataFrame:
    """Failing keys of the 24 raw checks, (check_number, failed_key, failed_rows)."""
    return reduce(DataFrame.unionByName, raw_failure_parts(raw, source_system))


def raw_failure_parts(
    raw: dict[str, DataFrame], source_system: str = vocab.SOURCE_SYSTEM, written: bool = False
) -> list[DataFrame]:
    """The same, one part per feed; ``written`` writes the ids that the feeds refer to, for parts that are run apart."""
    known = raw["incidents"].select(F.json_tuple("payload", "incident_id").alias("p_incident_id"), has_object_payload().alias("_object"))
    known = known.where(F.col("_object") & truthy("p_incident_id")).select(F.col("p_incident_id").alias("_ref")).distinct()
    known = checkpoint(known) if written else known
    parts = []
    for feed in RAW_FEEDS:
        records = payload_fields(raw[feed.core], feed)
        table = feed.target_table
        unknown = ~F.coalesce(F.col("source_system") == source_system, F.lit(False))
        copies = raw[feed.core].groupBy(*KEY).agg((F.count(F.lit(1)) - 1).alias("copies")).where("copies > 0")
        repeated = _failures(copies, check_number("duplicate_source_record", table), record_key(), F.col("copies"))
        missing = missing_fields(feed)
        incomplete = F.when(~has_object_payload(), record_key()).when(
            missing != "", F.concat(record_key(), F.lit(" missing="), missing)
        )
        bad_dates = [
            F.when(
                has_object_payload() & truthy(f"p_{name}") & ~is_iso(f"p_{name}"),
                F.concat(record_key(), F.lit(f" field={name}")),
            )
            for name in feed.dates
        ]
        # A record is parsed once and asked for every flaw that it shows by itself.
        keys = [("unknown_source_system", F.when(unknown, record_key())), ("missing_required_fields", incomplete)]
        keys += [("invalid_date_format", key) for key in bad_dates]
        flaws = [F.when(key.isNotNull(), _flaw(check_number(name, table), key)) for name, key in keys]
        if feed.core == "incidents":
            found = explode_present(records, flaws, "f")
        else:
            linked = feed.core == "alerts"
            number = check_number("missing_infrastructure_request_reference", table)
            # among the fields that are parsed already
            ref = F.when(has_object_payload(), F.col("p_linked_incident_id" if linked else "p_incident_id"))
            asks = _flaw(number, record_key(), ref)
            items = [*flaws, F.when(truthy(ref), asks) if linked else asks]
            asked = explode_present(records, items, "f")
            # Other flaws of the record ride along without a reference, so the record is not made a second time for it.
            key = spread_nulls(F.col("f.ref"), "f.number", "f.k")
            asked = asked.join(known, key == F.col("_ref"), "left")
            found = asked.where((F.col("f.number") != number) | F.col("_ref").isNull())
        parts.append(repeated.unionByName(_failures(found, F.col("f.number"), F.col("f.k"))))
    return parts


def _flaw(number: int, key: Column, ref: Column | None = None) -> Column:
    """A failing key of a record; with a reference it fails only where no incident has that id."""
    ref = F.lit(None).cast("string") if ref is None else ref
    return F.struct(F.lit(number).alias("number"), key.alias("k"), ref.alias("ref"))


def core_failures(
    core: dict[str, DataFrame], hot_rows: int | None = HOT_ROWS, first: int = 1, last: int = len(CHECKS)
) -> DataFrame:
    """Failing keys of the 17 core checks, or of those among them that are numbered ``first`` to ``last``."""
    return reduce(DataFrame.unionByName, core_failure_parts(core, hot_rows, first, last))


def core_failure_parts(
    core: dict[str, DataFrame], hot_rows: int | None = HOT_ROWS, first: int = 1, last: int = len(CHECKS)
) -> list[DataFrame]:
    """The same in two parts: the rules of transition, which sort the whole history, and what is left."""
    incidents, events, assets = core["incidents"], core["events"], core["assets"]
    orders, validations, alerts = core["work_orders"], core["validations"], core["alerts"]
    early = events.join(incidents.select("incident_id", "reported_at"), "incident_id").where(
        "occurred_at < reported_at"
    )
    done = orders.where(F.col("work_order_status").isin(vocab.COMPLETED_WORK)).select("incident_id")
    plain = {
        "infrastructure_incident_without_stage_event": (
            incidents.join(events.select("incident_id"), "incident_id", "left_anti"),
            "incident_id",
        ),
        "stage_event_timestamp_out_of_order": (early, "event_id"),
        "work_order_without_request": (
            orders.join(incidents.select("incident_id"), "incident_id", "left_anti"),
            "work_order_id",
        ),
        "validation_without_completed_work": (validations.join(done, "incident_id", "left_anti"), "validation_id"),
        "spare_waiting_without_required_spare": (
            orders.where((F.col("work_order_status") == "WAITING_SPARE_VENDOR") & ~truthy("required_spare_id")),
            "work_order_id",
        ),
        "telemetry_alert_without_known_asset": (
            alerts.join(assets.select("asset_id"), "asset_id", "left_anti"),
            "telemetry_alert_id",
        ),
    }
    by_issue = {
        "workflow_ontology_incident_vocabulary": (validators.incident_vocabulary(incidents), None),
        "workflow_ontology_stage_event_vocabulary": (validators.event_vocabulary(events), "event_id"),
        "workflow_ontology_impact_vocabulary": (
            validators.impact_vocabulary(core["snapshots"], incidents),
            "impact_snapshot_id",
        ),
        "workflow_ontology_zone_vocabulary": (validators.zone_vocabulary(core["zones"]), "zone_id"),
        "workflow_ontology_asset_vocabulary": (validators.asset_vocabulary(assets), "asset_id"),
        "workflow_ontology_dependency_vocabulary": (
            validators.dependency_vocabulary(core["dependencies"], assets),
            "dependency_id",
        ),
        "workflow_ontology_spare_vocabulary": (validators.spare_vocabulary(core["spares"]), "spare_id"),
        "workflow_ontology_work_order_vocabulary": (validators.work_order_vocabulary(orders), "work_order_id"),
        "workflow_ontology_validation_vocabulary": (validators.validation_vocabulary(validations), "validation_id"),
        "workflow_ontology_telemetry_vocabulary": (validators.telemetry_vocabulary(alerts), "telemetry_alert_id"),
    }
    plain_parts, history = [], []
    for name, table, _, _ in CHECKS[RAW_CHECK_COUNT:]:
        number = check_number(name, table)
        if not first <= number <= last:
            continue
        if name in plain:
            rows, key = plain[name]
            plain_parts.append(_failures(rows, number, F.col(key)))
        elif name == "workflow_ontology_transition_rules":
            issues = validators.transition_rules(events, incidents, hot_rows)
            event = F.coalesce(F.get_json_object("evidence_json", "$.event_id"), F.lit(""))
            history.append(_failures(issues, number, F.trim(F.concat_ws(" ", "incident_id", "issue_type", event))))
        else:
            rows, field = by_issue[name]
            subject = F.col("incident_id") if field is None else F.get_json_object("evidence_json", f"$.{field}")
            plain_parts.append(_failures(rows, number, F.concat_ws(" ", subject, "issue_type")))
    return [*history, *([reduce(DataFrame.unionByName, plain_parts)] if plain_parts else [])]


def check_results(
    failures: DataFrame | list[DataFrame], run_id: str, first: int = 1, last: int = len(CHECKS)
) -> DataFrame:
    """One row per check, passed ones too. Samples are the ten smallest failing keys, limited before the shuffle.

    Parts are written one after the other, so local disks hold the shuffle files of one of them at a time.
    """
    parts = failures if isinstance(failures, list) else [failures]
    spark = parts[0].sparkSession
    rows = [(i, *check) for i, check in enumerate(CHECKS, start=1) if first <= i <= last]
    listing = spark.createDataFrame(
        rows, "check_number INT, check_name STRING, target_table STRING, severity STRING, message STRING"
    )
    failures = reduce(DataFrame.unionByName, [checkpoint(part) for part in parts])  # totals and samples both read them
    totals = failures.groupBy("check_number").agg(F.sum("failed_rows").alias("failed_row_count"))
    smallest = first_per_group(failures, ["check_number"], [F.asc("failed_key")], SAMPLE_KEYS)
    repeated = F.transform(
        F.sort_array(F.collect_list(F.struct("failed_key", "failed_rows"))),
        lambda r: F.array_repeat(r["failed_key"], F.least(r["failed_rows"], F.lit(SAMPLE_KEYS)).cast("int")),
    )
    samples = smallest.groupBy("check_number").agg(F.slice(F.flatten(repeated), 1, SAMPLE_KEYS).alias("keys"))
    joined = listing.join(totals, "check_number", "left").join(samples, "check_number", "left")
    failed = F.coalesce("failed_row_count", F.lit(0)).cast("bigint")
    return joined.select(
        F.concat(F.lit(f"DQ-{run_id}-"), F.lpad(F.col("check_number").cast("string"), 3, "0")).alias(
            "check_result_id"
        ),
        F.lit(run_id).alias("pipeline_run_id"),
        "check_name",
        "target_table",
        "severity",
        F.when(failed > 0, "FAILED").otherwise("PASS").alias("status"),
        failed.alias("failed_row_count"),
        F.coalesce("keys", F.array().cast("array<string>")).alias("sample_failed_keys"),
        "message",
    )
