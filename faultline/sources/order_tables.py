"""Incident tables derived from an order-style star schema, so that the operators can run on tables of any size.

The column expressions below are written once in the SQL both Spark and the checking database read; only ``HOURS(n)``
(an interval) is replaced per engine. All event times fall on whole hours, so durations are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions.scalar import explode_present
from faultline.session import configure
from faultline.sources.contracts import FEED_BY_CORE
from faultline.vocab import EXIT_EVENT, SOURCE_SYSTEM, STAGES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def case(key: str, values: list[str], otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} {arms} ELSE {otherwise} END"


def stage_of(line: str) -> str:
    return f"CASE {line} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STAGES, 1)) + " END"


LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
STATUSES = ["RUNNING", "DEGRADED", "STOPPED", "LOCKED_OUT", "AT_RISK"]
LINE = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
SYSTEM = f"'{SOURCE_SYSTEM}'"
QTY = "CAST(l_quantity AS INT)"
ENTER_HOURS = f"24 * (l_linenumber - 1) + {QTY} - CASE WHEN l_partkey % 100 = 99 THEN 400 ELSE 0 END"
EXIT_HOURS = f"{ENTER_HOURS} + CAST(round(l_discount * 100) AS INT) * 4 + 1"
IMPACT_HOURS = f"{ENTER_HOURS} + 2"
EXIT_TYPE = (
    "CASE l_linenumber "
    + " ".join(f"WHEN {i} THEN '{EXIT_EVENT[s]}'" for i, s in enumerate(STAGES[:-1], 1))
    + " ELSE 'INCIDENT_RESTORED' END"
)
IMPACT_TYPE = (
    "CASE WHEN l_partkey % 200 = 199 THEN 'UNKNOWN_TYPE' WHEN l_returnflag = 'R' THEN "
    + case("l_suppkey % 4", ["REDUNDANCY_LOST", "REDUNDANCY_RESTORED", "VENDOR_ETA_UPDATED", "VENDOR_ETA_MISSED"])
    + " ELSE "
    + case("l_suppkey % 3", ["LOAD_SHIFTED", "MITIGATION_APPLIED", "VALIDATION_FAILED"])
    + " END"
)
# suffix, event type, hours after the order, condition
EVENT_KINDS = [
    ("E", "'ENTERED_STAGE'", ENTER_HOURS, "l_linenumber IS NOT NULL"),
    ("X", EXIT_TYPE, EXIT_HOURS, "l_linestatus = 'F'"),
    ("I", IMPACT_TYPE, IMPACT_HOURS, "l_returnflag <> 'N'"),
]
# The relation each table reads; "lines" is lineitem with its order, "order_lines" is orders with their line summary.
SOURCE = {
    "zones": "zone_rows",
    "assets": "supplier",
    "dependencies": "supplier",
    "engineers": "customer",
    "spares": "part",
    "incident_candidates": "order_lines",
    "events": "line_events",
    "work_orders": "work_lines",
    "validations": "check_lines",
    "alerts": "event_rows",
    "snapshots": "impact_lines",
}
COLUMNS = {
    "zones": {
        "zone_id": "'ZONE-' || n_nationkey",
        "zone_code": "'Z' || n_nationkey",
        "zone_name": "n_name",
        "facility_area": "r_name",
        "zone_priority": case("n_regionkey", LEVELS, "'UNRATED'"),
        "current_status": case("n_nationkey % 6", STATUSES, "'OFFLINE'"),
    },
    "assets": {
        "asset_id": "'ASSET-' || s_suppkey",
        "asset_code": "'A' || s_suppkey",
        "asset_name": "s_name",
        "asset_type": case("s_suppkey % 5", ["UPS", "PDU", "CRAH", "CHILLER", "GENERATOR"]),
        "zone_id": "'ZONE-' || s_nationkey",
        "criticality_level": f"CASE WHEN s_suppkey % 25 = 24 THEN 'EXTREME' ELSE {case('s_suppkey % 4', LEVELS)} END",
        "installed_at": "TIMESTAMP_NTZ '2020-01-01 00:00:00'",
        "manufacturer": "'MFG-' || (s_suppkey % 7)",
        "model_number": "'M' || (s_suppkey % 11)",
        "current_status": "CASE WHEN s_suppkey % 25 = 13 THEN 'OFFLINE' WHEN s_acctbal < 0 THEN 'STOPPED' "
        "ELSE 'RUNNING' END",
    },
    "dependencies": {
        "dependency_id": "'DEP-' || s_suppkey",
        "dependent_asset_id": "'ASSET-' || s_suppkey",
        "dependency_asset_id": "CASE WHEN s_suppkey % 20 = 19 THEN 'ASSET-X' || s_suppkey "
        "ELSE 'ASSET-' || CAST(floor(s_suppkey / 2.0) AS BIGINT) END",
        "dependency_type": case(
            "s_suppkey % 5", ["POWER_PATH", "COOLING_PATH", "CONTROL_TELEMETRY", "REDUNDANCY_SUPPORT"],
            "'UNKNOWN_LINK'"
        ),
        "dependency_role": case("s_suppkey % 4", ["PRIMARY", "SECONDARY", "BACKUP"], "'TERTIARY'"),
        "impact_scope": case("s_suppkey % 3", ["RACK", "ROW", "ZONE"]),
        "source_system": SYSTEM,
        "metadata_json": "CAST(NULL AS STRING)",
    },
    "engineers": {
        "engineer_id": "'ENG-' || c_custkey",
        "engineer_name": "c_name",
        "team_name": "'TEAM-' || (c_nationkey % 5)",
        "skill_group": "c_mktsegment",
        "shift": case("c_custkey % 3", ["DAY", "NIGHT", "SWING"]),
        "active_status": "c_acctbal >= 0",
    },
    "spares": {
        "spare_id": "'SPARE-' || p_partkey",
        "spare_number": "'P' || p_partkey",
        "spare_name": "p_name",
        "spare_category": "p_brand",
        "stock_status": f"CASE WHEN p_size = 50 THEN 'BACKORDER' ELSE "
        f"{case('p_size % 3', ['IN_STOCK', 'LOW_STOCK', 'OUT_OF_STOCK'])} END",
        "lead_time_days": "CAST(p_size AS DOUBLE)",
        "critical_spare": "p_size > 40",
    },
    "incident_candidates": {
        "incident_id": "'INC-' || o_orderkey",
        "request_number": "'REQ-' || o_orderkey",
        "asset_id": "'ASSET-' || (first_line % 1000000)",
        "zone_id": "'ZONE-' || (o_custkey % 25)",
        "request_title": "'Incident ' || o_orderkey",
        "request_type": case("o_custkey % 4", ["PREVENTIVE", "CORRECTIVE", "BREAKDOWN", "VALIDATION_FINDING"]),
        "priority_level": "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' "
        "WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'UNSPECIFIED' END",
        "failure_mode": case("o_orderkey % 6", ["FAN_WEAR", "BREAKER_TRIP", "PUMP_FAILURE", "COOLANT_LOW",
                                                "INLET_HOT", "METER_DRIFT"]),
        "reported_at": "o_orderdate",
        "needed_by_at": "o_orderdate + HOURS(24 * (1 + o_custkey % 30))",
        "current_stage": "CASE WHEN o_orderstatus = 'F' THEN 'RESTORED' WHEN o_orderkey % 50 = 7 THEN 'UNKNOWN_STAGE' "
        f"ELSE {stage_of('LEAST(COALESCE(last_line, 1), 6)')} END",
        "current_status": "CASE WHEN o_orderstatus = 'F' THEN 'RESTORED' WHEN o_orderkey % 97 = 5 THEN 'PAUSED' "
        "ELSE 'IN_PROGRESS' END",
        "business_impact": case("o_orderkey % 5", ["GPU_COOLING_CAPACITY_AT_RISK", "PLANNED_MAINTENANCE",
                                                   "power_redundancy_risk", "OFFICE_LIGHTING",
                                                   "HOT_AISLE_TEMPERATURE_RISK"]),
        "estimated_downtime_hours": "CAST(o_orderkey % 40 + 1 AS DOUBLE)",
        "actual_downtime_hours": "CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 7 = 0 THEN "
        "CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 30 + 1 AS DOUBLE) END END",
        "h": "CAST(o_orderkey AS BIGINT)",
    },
    "events": {
        "event_id": f"'EVT-' || {LINE} || '-' || suffix",
        "incident_id": "'INC-' || l_orderkey",
        "stage": f"CASE WHEN l_suppkey % 50 = 49 THEN 'UNKNOWN_STAGE' ELSE {stage_of('l_linenumber')} END",
        "event_type": "kind",
        "event_status": "CASE WHEN l_tax > 0.075 THEN 'DROPPED' ELSE 'SUCCESS' END",
        "occurred_at": "o_orderdate + HOURS(hours)",
        "actor_type": "'SYSTEM'",
        "actor_id": "CAST(NULL AS STRING)",
        "reason_code": "CASE WHEN suffix = 'I' THEN 'IMPACT' END",
        "metadata_json": "'{\"message\":\"' || kind || ' ' || l_linenumber || '\"}'",
        "source_system": SYSTEM,
        "h": "l_orderkey * 7 + l_linenumber",
    },
    "work_orders": {
        "work_order_id": f"'WO-' || {LINE}",
        "incident_id": "'INC-' || l_orderkey",
        "assigned_team": "'TEAM-' || (l_suppkey % 5)",
        "assigned_engineer_id": "CASE WHEN l_partkey % 3 <> 0 THEN 'ENG-' || (l_partkey % 120) END",
        "work_order_status": "CASE WHEN l_partkey % 150 = 149 THEN 'CANCELLED' "
        "WHEN l_linenumber = 3 THEN CASE WHEN l_linestatus = 'F' THEN 'ASSIGNED' ELSE 'ASSIGNMENT_PENDING' END "
        "WHEN l_linenumber = 4 THEN CASE WHEN l_linestatus = 'F' THEN 'IN_PROGRESS' ELSE 'WAITING_SPARE_VENDOR' END "
        "WHEN l_linestatus = 'F' THEN 'REPAIR_COMPLETED' ELSE 'IN_PROGRESS' END",
        "planned_start_at": "l_shipdate",
        "actual_start_at": "CASE WHEN l_linestatus = 'F' THEN l_shipdate + HOURS(4) END",
        "actual_completed_at": "CASE WHEN l_linestatus = 'F' AND l_linenumber = 5 THEN l_shipdate + HOURS(9) END",
        "required_spare_id": "CASE WHEN l_suppkey % 4 <> 0 THEN 'SPARE-' || l_partkey END",
        "h": "l_orderkey * 7 + l_linenumber",
    },
    "validations": {
        "validation_id": f"'VAL-' || {LINE}",
        "incident_id": "'INC-' || l_orderkey",
        "validation_status": "CASE WHEN l_suppkey % 37 = 36 THEN 'SKIPPED' WHEN l_suppkey % 11 = 10 THEN 'FAILED' "
        "WHEN l_linestatus = 'F' THEN 'PASSED' ELSE 'PENDING' END",
        "validator_id": "CASE WHEN l_partkey % 4 <> 0 THEN 'ENG-' || (l_partkey % 120) END",
        "validation_started_at": "l_shipdate",
        "validation_completed_at": "CASE WHEN l_linestatus = 'F' THEN l_shipdate + HOURS(6) END",
        "failure_reason": "CASE WHEN l_suppkey % 11 = 10 THEN 'THERMAL' END",
        "h": "l_orderkey * 7 + l_linenumber",
    },
    "alerts": {
        "telemetry_alert_id": "'ALERT-' || event_id",
        "asset_id": "'ASSET-' || user_id",
        "alert_type": "event_type",
        "severity": "CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'WARNING' "
        "WHEN 'signup' THEN 'NOTICE' ELSE 'INFO' END",
        "triggered_at": "ts",
        "resolved_at": "CASE WHEN event_id % 2 = 0 THEN ts + HOURS(5) END",
        "linked_incident_id": "CASE WHEN event_id % 3 = 0 THEN 'INC-' || event_id END",
        "metadata_json": "props",
        "h": "event_id",
    },
    "snapshots": {
        "impact_snapshot_id": f"'IMPACT-' || {LINE}",
        "incident_id": "'INC-' || l_orderkey",
        "asset_id": "'ASSET-' || l_suppkey",
        "zone_id": "'ZONE-' || (l_suppkey % 25)",
        "snapshot_at": "l_shipdate",
        "redundancy_state": "CASE WHEN l_partkey % 40 = 39 THEN 'N+2' ELSE "
        + case("l_partkey % 3", ["N+1", "N", "N-1"]) + " END",
        "affected_rack_count": "CAST(floor(l_quantity / 5) AS INT)",
        "affected_gpu_count": f"CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE {QTY} END",
        "estimated_capacity_risk_kw": "CASE WHEN l_partkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE l_quantity * 15 END",
        "estimated_gpu_capacity_risk_pct": "l_quantity / 2",
        "thermal_breach_minutes": "CAST(l_partkey % 7 * 12 AS INT)",
        "power_redundancy_lost": "l_partkey % 6 = 1",
        "cooling_redundancy_lost": "l_partkey % 10 = 3",
        "mitigation_status": "CASE WHEN l_suppkey % 31 = 30 THEN 'PARTIAL' ELSE "
        + case("l_suppkey % 5", ["NONE", "LOAD_SHIFTED", "RUNNING_DEGRADED", "VERIFIED_NORMAL"], "'NONE'") + " END",
        "vendor_eta_at": "CASE WHEN l_suppkey % 4 IN (1, 2) THEN l_shipdate + HOURS(48) END",
        "vendor_status": "CASE WHEN l_suppkey % 43 = 42 THEN 'LOST' ELSE "
        + case("l_suppkey % 4", ["NOT_REQUIRED", "ETA_CONFIRMED", "WAITING_VENDOR_DISPATCH", "ETA_MISSED"]) + " END",
        "source_system": SYSTEM,
        "metadata_json": "CAST(NULL AS STRING)",
        "reading_status": case("l_partkey % 4", ["NORMAL", "warning", "CRITICAL", "AT_RISK"]),
    },
}
# Rules of the flawed raw feeds, on the row number ``h``.
FOREIGN, BLANK_SYSTEM, NOT_OBJECT, COPIED = "h % 59 = 0", "h % 61 = 0", "h % 67 = 0", "h % 10 = 0"
NULL_FIELD, EMPTY_FIELD, BAD_DATE, BAD_REFERENCE = "h % 41 = 0", "h % 43 = 0", "h % 47 = 0", "h % 53 = 0"


def replace_hours(text: str, template: str) -> str:
    """Replace each HOURS(argument) by ``template`` with the argument filled in."""
    result, i = "", 0
    while (start := text.find("HOURS(", i)) >= 0:
        depth, end = 1, start + len("HOURS(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        result += text[i:start] + template.format(text[start + len("HOURS(") : end - 1])
        i = end
    return result + text[i:]


def spark_sql(text: str) -> str:
    return replace_hours(text, "make_dt_interval(0, CAST({} AS INT))")


def _select(df: DataFrame, table: str) -> DataFrame:
    return df.selectExpr(*[f"{spark_sql(expr)} AS {name}" for name, expr in COLUMNS[table].items()])


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    configure(spark)
    return {name: _spread(spark.read.parquet(f"{folder}/{name}.parquet")) for name in ["lineitem", "orders"]} | {
        name: spark.read.parquet(f"{folder}/{name}.parquet") for name in TABLES if name not in ("lineitem", "orders")
    }


def _spread(df: DataFrame) -> DataFrame:
    """A small file is one row group and would keep one core busy; files with enough splits are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def incident_tables(spark: SparkSession, folder: str, keep_row_number: bool = False) -> dict[str, DataFrame]:
    """The eleven core tables plus ``incident_candidates``, which also has the orders without any line."""
    t = read_tables(spark, folder)
    first = "min(l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS first_line"
    summary = t["lineitem"].groupBy("l_orderkey").agg(F.expr(first), F.expr("max(l_linenumber) AS last_line"))
    structs = [
        f"CASE WHEN {condition} THEN named_struct('suffix', '{suffix}', 'kind', {kind}, 'hours', {hours}) END"
        for suffix, kind, hours, condition in EVENT_KINDS
    ]
    lines = t["lineitem"].join(
        t["orders"].select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    relations = {
        "zone_rows": t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")),
        "supplier": t["supplier"],
        "customer": t["customer"],
        "part": t["part"],
        "order_lines": t["orders"].join(summary, F.col("o_orderkey") == F.col("l_orderkey"), "left"),
        "line_events": explode_present(lines, [F.expr(s) for s in structs], "ev", "*").select("*", "ev.*"),
        "work_lines": t["lineitem"].where("l_linenumber IN (3, 4, 5)"),
        "check_lines": t["lineitem"].where("l_linenumber = 6"),
        "event_rows": t["events"],
        "impact_lines": t["lineitem"].where("l_returnflag = 'R'"),
    }
    made = {name: _select(relations[SOURCE[name]], name) for name in COLUMNS}
    made["incidents"] = made["incident_candidates"].where("asset_id IS NOT NULL")
    reading = "named_struct('metric', '{}', 'value', {}, 'unit', '{}', 'status', {})"
    readings = [reading.format("inlet_temp", "CAST(31 AS DOUBLE)", "C", "reading_status"),
                reading.format("load", "CAST(0.5 AS DOUBLE)", "ratio", "'NORMAL'")]
    made["snapshots"] = made["snapshots"].withColumn("telemetry_readings", F.expr(f"array({', '.join(readings)})"))
    result = {}
    for name, df in made.items():
        extra = ["h"] if keep_row_number and "h" in df.columns else []
        wanted = [*schemas.column_names(schemas.CORE["incidents" if name == "incident_candidates" else name]), *extra]
        result[name] = df.select(*wanted)
    return result


def raw_feeds(spark: SparkSession, folder: str, bad_dates: bool = True) -> dict[str, DataFrame]:
    """The five raw feeds as envelopes with JSON payloads; a rule on the row number damages some of them.

    Copies of a record differ in ``position``, which is all the load looks at.
    """
    core = incident_tables(spark, folder, keep_row_number=True)
    feeds = {}
    for name, feed in FEED_BY_CORE.items():
        rows = core["incident_candidates" if name == "incidents" else name]
        fields = []
        for field in feed.fields:
            if field not in rows.columns:
                continue
            value = F.col(field)
            if dict(rows.dtypes)[field].startswith("timestamp"):
                value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
            value = value.cast("string")
            if field == feed.required[-1]:
                value = F.when(F.expr(EMPTY_FIELD), "").otherwise(value)
            if bad_dates and field == feed.dates[0]:
                value = F.when(F.expr(f"{BAD_DATE} AND NOT {EMPTY_FIELD}"), "not-a-date").otherwise(value)
            if field == feed.required[2]:
                value = F.when(F.expr(NULL_FIELD), None).otherwise(value)
            if name != "incidents" and field == ("linked_incident_id" if name == "alerts" else "incident_id"):
                value = F.when(F.expr(BAD_REFERENCE), F.concat(F.lit("INC-MISSING-"), "h")).otherwise(value)
            fields.append(value.alias(field))
        system = f"CASE WHEN {FOREIGN} THEN 'legacy_system' WHEN {BLANK_SYSTEM} THEN '' ELSE {SYSTEM} END"
        key = schemas.PRIMARY_KEY[name]
        copies = F.expr(f"explode(CASE WHEN {COPIED} THEN array(0, 1) ELSE array(0) END)")
        enveloped = rows.select(
            F.expr(system).alias("source_system"),
            F.concat(F.lit("SRC-"), key).alias("source_record_id"),
            F.when(F.expr(NOT_OBJECT), "oops").otherwise(F.to_json(F.struct(*fields))).alias("payload"),
            "h",
        )
        feeds[name] = enveloped.withColumn("position", copies).drop("h")
    return feeds
