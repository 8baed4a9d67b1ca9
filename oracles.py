"""Checking SQL for the registered queries: the same results computed by a plain SQL database.

``CTES`` holds named relations; ``build`` puts the ones a query needs, in order, in front of it. The rules are written
here the way a SQL user would write them, independently of how the Spark jobs compute them.
"""

from __future__ import annotations

import re

from faultline import schemas, vocab
from faultline.operators.quality import CHECKS, check_number
from faultline.sources import order_tables as m
from faultline.sources.contracts import FEED_BY_CORE, RAW_FEEDS, TOPOLOGY_FEED

CTES: dict[str, str] = {}


def build(final: str) -> str:
    """WITH clause of every named relation the text mentions, directly or through another, then the text."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\bc_\w+", sql):
            if name in CTES and name not in needed:
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    head = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in needed)
    return f"WITH {head}\n{final}" if needed else final


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def lookup(key: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


def js(**fields: str) -> str:
    inner = ", ".join(f"'{k}': {v}" for k, v in fields.items())
    return "CAST(to_json({" + inner + "}) AS VARCHAR)"


# --- model tables ------------------------------------------------------------------------------------


def duck(expr: str) -> str:
    text = m.replace_hours(expr, "to_hours(CAST({} AS BIGINT))")
    return text.replace("TIMESTAMP_NTZ '", "TIMESTAMP '")


def columns(table: str, names: list[str] | None = None) -> str:
    picked = m.COLUMNS[table] if names is None else {n: m.COLUMNS[table][n] for n in names}
    return ", ".join(f"{duck(expr)} AS {name}" for name, expr in picked.items())


_lines = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_kinds = " UNION ALL ".join(
    f"SELECT *, '{suffix}' AS suffix, {kind} AS kind, {hours} AS hours FROM {_lines} WHERE {condition}"
    for suffix, kind, hours, condition in m.EVENT_KINDS
)
CTES["c_zones"] = f"SELECT {columns('zones')} FROM nation JOIN region ON n_regionkey = r_regionkey"
CTES["c_assets"] = f"SELECT {columns('assets')} FROM supplier"
CTES["c_dependencies"] = f"SELECT {columns('dependencies')} FROM supplier"
CTES["c_engineers"] = f"SELECT {columns('engineers')} FROM customer"
CTES["c_spares"] = f"SELECT {columns('spares')} FROM part"
CTES["c_candidates"] = (
    f"SELECT {columns('incident_candidates')} FROM orders LEFT JOIN (SELECT l_orderkey, "
    "min(l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS first_line, "
    "max(l_linenumber) AS last_line FROM lineitem GROUP BY l_orderkey) s ON o_orderkey = l_orderkey"
)
CTES["c_incidents"] = "SELECT * FROM c_candidates WHERE asset_id IS NOT NULL"
CTES["c_events"] = f"SELECT {columns('events')} FROM ({_kinds}) k"
CTES["c_work_orders"] = f"SELECT {columns('work_orders')} FROM lineitem WHERE l_linenumber IN (3, 4, 5)"
CTES["c_validations"] = f"SELECT {columns('validations')} FROM lineitem WHERE l_linenumber = 6"
CTES["c_alerts"] = f"SELECT {columns('alerts')} FROM events"
CTES["c_snapshots"] = f"SELECT {columns('snapshots')} FROM lineitem WHERE l_returnflag = 'R'"


def _raw(name: str, bad_dates: bool) -> str:
    feed = FEED_BY_CORE[name]
    model = "incident_candidates" if name == "incidents" else name
    source = "c_candidates" if name == "incidents" else f"c_{name}"
    fields = []
    for field in feed.fields:
        if field not in m.COLUMNS[model]:
            continue
        value = f"CAST({field} AS VARCHAR)"
        if field == feed.required[-1]:
            value = f"CASE WHEN {m.EMPTY_FIELD} THEN '' ELSE {value} END"
        if bad_dates and field == feed.dates[0]:
            value = f"CASE WHEN {m.BAD_DATE} AND NOT {m.EMPTY_FIELD} THEN 'not-a-date' ELSE {value} END"
        if field == feed.required[2]:
            value = f"CASE WHEN {m.NULL_FIELD} THEN NULL ELSE {value} END"
        if name != "incidents" and field == ("linked_incident_id" if name == "alerts" else "incident_id"):
            value = f"CASE WHEN {m.BAD_REFERENCE} THEN 'INC-MISSING-' || h ELSE {value} END"
        fields.append(f"CASE WHEN {m.NOT_OBJECT} THEN NULL ELSE {value} END AS {field}")
    renamed = [f.replace(" AS source_system", " AS p_source_system") for f in fields]
    system = (
        f"CASE WHEN {m.FOREIGN} THEN 'legacy_system' WHEN {m.BLANK_SYSTEM} THEN '' ELSE '{vocab.SOURCE_SYSTEM}' END"
    )
    return (
        f"SELECT {system} AS source_system, 'SRC-' || {schemas.PRIMARY_KEY[name]} AS source_record_id, "
        f"NOT ({m.NOT_OBJECT}) AS is_object, copy AS position, {', '.join(renamed)} "
        f"FROM {source}, LATERAL (SELECT unnest(CASE WHEN {m.COPIED} THEN [0, 1] ELSE [0] END) AS copy) x"
    )


for _feed in RAW_FEEDS:
    CTES[f"c_raw_{_feed.core}"] = _raw(_feed.core, True)
    CTES[f"c_clean_{_feed.core}"] = _raw(_feed.core, False)
    for _kind in ("raw", "clean"):
        _src = f"c_{_kind}_{_feed.core}"
        _ok = "coalesce(source_system, '') <> '' AND coalesce(source_record_id, '') <> '' AND is_object"
        CTES[f"c_loaded_{_kind}_{_feed.core}"] = (
            f"SELECT * FROM {_src} WHERE {_ok} QUALIFY row_number() OVER "
            "(PARTITION BY source_system, source_record_id ORDER BY position) = 1"
        )
        CTES[f"c_unloaded_{_kind}_{_feed.core}"] = (
            f"SELECT '{_feed.target_table}:missing_source_or_payload' AS rejected_key, count(*) AS rejected_rows "
            f"FROM {_src} WHERE NOT ({_ok}) HAVING count(*) > 0 UNION ALL "
            f"SELECT '{_feed.target_table}:' || source_system || ':' || source_record_id, count(*) - 1 FROM {_src} "
            f"WHERE {_ok} GROUP BY source_system, source_record_id HAVING count(*) > 1"
        )


def _prefixed(field: str) -> str:
    return "p_source_system" if field == "source_system" else field


def accepted(name: str) -> str:
    """Clean-feed rows that have their required fields and references."""
    feed = FEED_BY_CORE[name]
    required = " AND ".join(f"coalesce({_prefixed(f)}, '') <> ''" for f in feed.required)
    inc = "incident_id IN (SELECT incident_id FROM c_accepted_incidents)"
    references = {
        "incidents": "asset_id IN (SELECT asset_id FROM c_assets) AND zone_id IN (SELECT zone_id FROM c_zones)",
        "events": inc,
        "work_orders": f"{inc} AND (coalesce(assigned_engineer_id, '') = '' OR assigned_engineer_id IN "
        "(SELECT engineer_id FROM c_engineers)) AND (coalesce(required_spare_id, '') = '' OR required_spare_id IN "
        "(SELECT spare_id FROM c_spares))",
        "validations": f"{inc} AND (coalesce(validator_id, '') = '' OR validator_id IN "
        "(SELECT engineer_id FROM c_engineers))",
        "alerts": "asset_id IN (SELECT asset_id FROM c_assets) AND (coalesce(linked_incident_id, '') = '' OR "
        "linked_incident_id IN (SELECT incident_id FROM c_accepted_incidents))",
    }[name]
    return f"SELECT * FROM c_loaded_clean_{name} WHERE {required} AND {references}"


for _feed in RAW_FEEDS:
    CTES[f"c_accepted_{_feed.core}"] = accepted(_feed.core)

# Two deliveries: the first has the records whose id ends in a small figure, the second the rest and some of them again.
for _feed in RAW_FEEDS:
    _n, _end = _feed.core, "source_record_id[-1]"
    _first = f"{_end} < '5'" if _n == "incidents" else f"{_end} < '7'"
    _second = "true" if _n == "incidents" else f"{_end} >= '5'"
    CTES[f"c_first_loaded_{_n}"] = f"SELECT * FROM c_loaded_clean_{_n} WHERE {_first}"
    CTES[f"c_first_accepted_{_n}"] = (
        accepted(_n).replace("c_accepted_", "c_first_accepted_").replace("c_loaded_clean_", "c_first_loaded_"))
    _count = "(SELECT count(*) FROM {})".format
    _all, _in1 = _count(f"c_loaded_clean_{_n}"), _count(f"c_first_loaded_{_n}")
    _ok, _ok1 = _count(f"c_accepted_{_n}"), _count(f"c_first_accepted_{_n}")
    CTES[f"c_two_runs_{_n}"] = (
        f"SELECT 'RUN-1' AS pipeline_run_id, '{_n}' AS feed, {_in1} AS rows_loaded, (SELECT count(*) FROM c_clean_{_n} WHERE "
        f"{_first}) - {_in1} AS rows_rejected, {_ok1} AS rows_accepted, {_in1} - {_ok1} AS rows_waiting UNION ALL "
        f"SELECT 'RUN-2', '{_n}', {_all} - {_in1}, (SELECT count(*) FROM c_clean_{_n} WHERE {_second}) - ({_all} - {_in1}), "
        f"{_ok} - {_ok1}, {_all} - {_ok}"
    )
CTES["c_two_runs"] = " UNION ALL ".join(f"SELECT * FROM c_two_runs_{feed.core}" for feed in RAW_FEEDS)

# --- workflow -------------------------------------------------------------------------------------------

_workflow_types = quoted([vocab.ENTERED, vocab.INCIDENT_RESTORED, *vocab.EXIT_EVENT.values()])
CTES["c_as_of"] = (
    f"SELECT coalesce(max(occurred_at) FILTER (event_type IN ({_workflow_types})), max(occurred_at)) "
    "+ INTERVAL 24 HOUR AS as_of FROM c_events"
)
CTES["c_ordered"] = (
    "SELECT *, row_number() OVER w AS rn, CASE WHEN lag(stage) OVER w = stage THEN 0 ELSE 1 END AS is_new "
    "FROM c_events WINDOW w AS (PARTITION BY incident_id ORDER BY occurred_at, event_id)"
)
CTES["c_runs"] = (
    "SELECT *, sum(is_new) OVER (PARTITION BY incident_id ORDER BY rn) AS run, "
    f"(event_type = 'INCIDENT_RESTORED' OR event_type = {lookup('stage', vocab.EXIT_EVENT, chr(39) + chr(39))}) "
    "AS is_exit FROM c_ordered"
)
CTES["c_pairs"] = (
    "SELECT e.incident_id, e.event_id, e.stage, e.occurred_at AS entered_at, min(x.occurred_at) AS exited_at "
    "FROM c_runs e LEFT JOIN c_runs x ON x.incident_id = e.incident_id AND x.run = e.run AND x.rn > e.rn AND x.is_exit "
    "WHERE e.event_type = 'ENTERED_STAGE' GROUP BY ALL"
)
CTES["c_leads"] = (
    "SELECT *, greatest(hours - threshold_hours, 0) AS delay_hours, hours > threshold_hours AS is_bottleneck FROM ("
    "SELECT p.*, greatest(epoch_us(coalesce(exited_at, as_of)) - epoch_us(entered_at), 0) / 3600000000.0 AS hours, "
    f"CAST({lookup('stage', vocab.THRESHOLD_HOURS, '0')} AS DOUBLE) AS threshold_hours FROM c_pairs p, c_as_of) t"
)
CTES["c_profile"] = (
    "SELECT l.incident_id, sum(delay_hours) AS total_delay_hours, any_value(o.d) AS open_delay_hours, "
    "any_value(r.d) AS repair_hours, any_value(b.stage) AS top_stage FROM c_leads l "
    "LEFT JOIN (SELECT incident_id, delay_hours AS d FROM c_leads WHERE exited_at IS NULL QUALIFY row_number() OVER "
    "(PARTITION BY incident_id ORDER BY entered_at DESC, event_id DESC) = 1) o ON o.incident_id = l.incident_id "
    "LEFT JOIN (SELECT incident_id, hours AS d FROM c_leads WHERE stage = 'REPAIR_IN_PROGRESS' QUALIFY row_number() "
    "OVER (PARTITION BY incident_id ORDER BY entered_at DESC, event_id DESC) = 1) r ON r.incident_id = l.incident_id "
    "LEFT JOIN (SELECT incident_id, stage FROM c_leads WHERE delay_hours > 0 QUALIFY row_number() OVER "
    "(PARTITION BY incident_id ORDER BY delay_hours DESC, entered_at, event_id) = 1) b "
    "ON b.incident_id = l.incident_id GROUP BY l.incident_id"
)
CTES["c_latest_asc"] = (
    "SELECT * FROM c_snapshots QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY snapshot_at DESC, "
    "impact_snapshot_id) = 1"
)
CTES["c_latest_desc"] = (
    "SELECT * FROM c_snapshots QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY snapshot_at DESC, "
    "impact_snapshot_id DESC) = 1"
)
CTES["c_owners"] = (
    "SELECT incident_id, first(assigned_team ORDER BY work_order_id) AS first_team, first(assigned_engineer_id ORDER BY "
    "work_order_id) FILTER (coalesce(assigned_engineer_id, '') <> '') AS first_engineer FROM c_work_orders "
    "GROUP BY incident_id"
)
CTES["c_status"] = (
    "SELECT i.incident_id, i.asset_id, i.zone_id, i.current_stage, i.current_status, l.entered_at AS stage_entered_at, "
    "round(l.hours, 2) AS hours_in_current_stage, (l.is_bottleneck OR i.needed_by_at < as_of) AS is_delayed, "
    "round(l.delay_hours, 2) AS delay_hours, i.needed_by_at, i.priority_level, i.business_impact, "
    f"{lookup('i.current_stage', vocab.OWNER_TYPE, chr(39) + 'UNKNOWN' + chr(39))} AS next_owner_type, "
    "CASE WHEN i.current_stage = 'REPAIR_IN_PROGRESS' THEN first_engineer WHEN i.current_stage IN "
    "('ENGINEER_ASSIGNED', 'SPARE_VENDOR_WAITING') THEN first_team END AS next_owner_id "
    "FROM c_incidents i JOIN (SELECT * FROM c_leads QUALIFY row_number() OVER (PARTITION BY incident_id, stage "
    "ORDER BY entered_at DESC, event_id DESC) = 1) l ON l.incident_id = i.incident_id AND l.stage = i.current_stage "
    "JOIN c_assets a ON a.asset_id = i.asset_id LEFT JOIN c_owners o ON o.incident_id = i.incident_id, c_as_of"
)

# --- summaries -----------------------------------------------------------------------------------------

CTES["c_dims"] = (
    "SELECT r.*, d.t AS dimension_type, d.v AS dimension_id FROM (SELECT l.*, i.asset_id, i.zone_id, i.priority_level, "
    "i.request_type, i.failure_mode, a.asset_type, a.criticality_level, a.asset_id AS known_asset, z.zone_id AS "
    "known_zone FROM c_leads l JOIN c_incidents i USING (incident_id) LEFT JOIN c_assets a ON a.asset_id = i.asset_id "
    "LEFT JOIN c_zones z ON z.zone_id = i.zone_id WHERE l.stage <> 'RESTORED') r, LATERAL (SELECT unnest(["
    "{'t': 'STAGE', 'v': stage}, {'t': 'PRIORITY_LEVEL', 'v': priority_level}, {'t': 'REQUEST_TYPE', 'v': request_type}, "
    "{'t': 'FAILURE_MODE', 'v': failure_mode}, {'t': 'ASSET', 'v': known_asset}, {'t': 'ASSET_TYPE', 'v': asset_type}, "
    "{'t': 'ASSET_CRITICALITY', 'v': criticality_level}, {'t': 'INFRASTRUCTURE_ZONE', 'v': known_zone}]) AS d) x "
    "WHERE d.v IS NOT NULL"
)
CTES["c_groups"] = (
    "SELECT dimension_type, dimension_id, stage, hours, delay_hours, is_bottleneck FROM c_dims UNION ALL "
    "SELECT 'FACILITIES_TEAM', w.assigned_team, l.stage, l.hours, l.delay_hours, l.is_bottleneck FROM c_leads l "
    "JOIN c_incidents USING (incident_id) JOIN c_work_orders w USING (incident_id) WHERE l.stage <> 'RESTORED' UNION ALL "
    "SELECT 'SPARE_CATEGORY', s.spare_category, l.stage, l.hours, l.delay_hours, l.is_bottleneck FROM c_leads l "
    "JOIN c_incidents USING (incident_id) JOIN c_work_orders w USING (incident_id) JOIN c_spares s ON s.spare_id = "
    "w.required_spare_id WHERE l.stage <> 'RESTORED'"
)
CTES["c_bottlenecks"] = (
    "SELECT CAST(as_of AS DATE) AS summary_date, g.* FROM (SELECT dimension_type, dimension_id, stage, count(*) AS "
    "request_count, count(*) FILTER (is_bottleneck) AS delayed_count, round(count(*) FILTER (is_bottleneck) / count(*), "
    "4) AS delay_rate, round(avg(hours), 2) AS avg_duration_hours, "
    "round(list_sort(list(hours))[CAST(round_even((count(*) - 1) * 0.9, 0) AS BIGINT) + 1], 2) AS p90_duration_hours, "
    "round(sum(delay_hours), 2) AS total_delay_hours FROM c_groups GROUP BY 1, 2, 3) g, c_as_of"
)
CTES["c_downtime"] = (
    "SELECT i.*, coalesce(nullif(actual_downtime_hours, 0), estimated_downtime_hours) AS downtime, p.total_delay_hours, "
    "p.repair_hours, p.top_stage, coalesce(s.is_delayed, false) AS late FROM c_incidents i JOIN c_profile p "
    "USING (incident_id) LEFT JOIN c_status s USING (incident_id)"
)
CTES["c_modes"] = (
    "SELECT asset_id, failure_mode FROM (SELECT asset_id, failure_mode, count(*) AS n FROM c_downtime GROUP BY 1, 2) t "
    "QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, failure_mode) = 1"
)
CTES["c_asset_delays"] = (
    "SELECT d.asset_id, a.asset_name, z.zone_id, z.zone_name, count(*) AS request_count, count(*) FILTER (late) AS "
    "delayed_request_count, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS repeat_failure_count, "
    "round(sum(downtime) + sum(total_delay_hours), 2) AS total_downtime_hours, round(coalesce(avg(repair_hours), 0), 2) "
    "AS avg_repair_duration_hours, any_value(o.failure_mode) AS top_failure_mode FROM c_downtime d JOIN c_assets a "
    "ON a.asset_id = d.asset_id JOIN c_zones z ON z.zone_id = a.zone_id JOIN c_modes o ON o.asset_id = d.asset_id "
    "GROUP BY 1, 2, 3, 4"
)
CTES["c_zone_top"] = (
    "SELECT zone_id, top_stage FROM (SELECT zone_id, top_stage, count(*) AS n FROM c_downtime WHERE top_stage IS NOT "
    "NULL GROUP BY 1, 2) t QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY n DESC, top_stage) = 1"
)
CTES["c_zone_delays"] = (
    "SELECT d.zone_id, z.zone_name, count(*) FILTER (d.current_status <> 'RESTORED') AS open_request_count, "
    "count(*) FILTER (late) AS delayed_request_count, count(*) FILTER (late AND a.criticality_level = 'CRITICAL') AS "
    "critical_asset_delayed_count, round(sum(downtime) + sum(total_delay_hours), 2) AS total_downtime_hours, "
    "coalesce(any_value(t.top_stage), 'NONE') AS top_bottleneck_stage FROM c_downtime d JOIN c_zones z "
    "ON z.zone_id = d.zone_id LEFT JOIN c_assets a ON a.asset_id = d.asset_id LEFT JOIN c_zone_top t ON t.zone_id = "
    "d.zone_id GROUP BY 1, 2"
)
CTES["c_spare_waits"] = (
    "SELECT s.spare_id, s.spare_name, s.spare_category, count(DISTINCT l.incident_id) AS waiting_request_count, "
    "round(sum(l.hours), 2) AS total_wait_hours, round(avg(l.hours), 2) AS avg_wait_hours, s.critical_spare, "
    "s.stock_status FROM c_leads l JOIN c_incidents USING (incident_id) JOIN c_work_orders w USING (incident_id) "
    "JOIN c_spares s ON s.spare_id = w.required_spare_id WHERE l.stage = 'SPARE_VENDOR_WAITING' AND l.delay_hours > 0 "
    "GROUP BY ALL"
)

# --- scores and queue ---------------------------------------------------------------------------------------

CTES["c_order_levels"] = (
    "SELECT w.*, s.spare_id, s.spare_name, s.stock_status, greatest(CASE WHEN work_order_status = "
    "'WAITING_SPARE_VENDOR' THEN 14 ELSE 0 END, CASE s.stock_status WHEN 'OUT_OF_STOCK' THEN 18 WHEN 'LOW_STOCK' THEN "
    "10 ELSE 0 END) AS level, CASE WHEN s.critical_spare THEN 4 ELSE 0 END AS extra FROM c_work_orders w LEFT JOIN "
    "c_spares s ON s.spare_id = w.required_spare_id"
)
# Folding "keep the highest level, then add" equals the best of level plus all extras from that order on.
CTES["c_spare_risk"] = (
    "SELECT incident_id, least(max(reach), 22) AS spare_risk, bool_or(coalesce(stock_status = 'OUT_OF_STOCK', false)) "
    "AS out_of_stock FROM (SELECT *, level + sum(extra) OVER (PARTITION BY incident_id ORDER BY work_order_id ROWS "
    "BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM c_order_levels) t GROUP BY incident_id"
)
CTES["c_scored"] = (
    "SELECT i.incident_id, i.asset_id, i.zone_id, i.current_stage, i.needed_by_at, s.is_delayed, "
    "s.hours_in_current_stage, a.criticality_level, z.zone_name, m.*  EXCLUDE (incident_id, asset_id, zone_id), "
    "out_of_stock, "
    f"CAST({lookup('a.criticality_level', vocab.CRITICALITY_SCORE, '0')} AS DOUBLE) AS asset_criticality_score, "
    "least(estimated_downtime_hours * CAST(1.2 AS DOUBLE), 30) AS downtime_score, "
    "least(coalesce(p.open_delay_hours, 0) / 3, 35) AS stage_delay_score, "
    f"CAST({lookup('z.zone_priority', vocab.ZONE_SCORE, '0')} AS DOUBLE) AS infrastructure_zone_impact_score, "
    "CAST(CASE WHEN i.needed_by_at < as_of THEN 24 WHEN i.needed_by_at <= as_of + INTERVAL 12 HOUR THEN 18 "
    "WHEN i.needed_by_at <= as_of + INTERVAL 24 HOUR THEN 12 WHEN i.needed_by_at <= as_of + INTERVAL 72 HOUR THEN 6 "
    "ELSE 2 END AS DOUBLE) AS needed_by_urgency_score, "
    "CAST(least((n.n - 1) * 8, 16) AS DOUBLE) AS repeat_failure_score, "
    "CAST(coalesce(r.spare_risk, 0) AS DOUBLE) AS spare_risk_score, "
    "CASE WHEN m.impact_snapshot_id IS NULL THEN 0 ELSE least(least(affected_gpu_count / 10, 24) + "
    "least(estimated_capacity_risk_kw / 100, 12), 30) END AS capacity_risk_score, "
    "CAST(CASE WHEN redundancy_state = 'N-1' THEN 24 WHEN power_redundancy_lost OR cooling_redundancy_lost THEN 18 "
    "WHEN redundancy_state = 'N' THEN 12 ELSE 0 END AS DOUBLE) AS redundancy_risk_score, "
    "least(coalesce(thermal_breach_minutes, 0) / 6, 18) AS thermal_risk_score, "
    "CAST(CASE WHEN vendor_status = 'ETA_MISSED' THEN 22 WHEN vendor_eta_at < as_of AND vendor_status <> "
    "'NOT_REQUIRED' THEN 18 WHEN vendor_status = 'WAITING_VENDOR_DISPATCH' THEN 14 WHEN vendor_status = "
    "'ETA_CONFIRMED' THEN 6 ELSE 0 END AS DOUBLE) AS vendor_eta_risk_score, "
    f"CAST({lookup('mitigation_status', vocab.MITIGATION_CREDIT, '0')} AS DOUBLE) AS mitigation_credit_score "
    "FROM c_incidents i JOIN c_status s ON s.incident_id = i.incident_id JOIN c_assets a ON a.asset_id = i.asset_id "
    "JOIN c_zones z ON z.zone_id = i.zone_id JOIN (SELECT asset_id, count(*) AS n FROM c_incidents GROUP BY 1) n "
    "ON n.asset_id = i.asset_id LEFT JOIN c_profile p ON p.incident_id = i.incident_id LEFT JOIN c_spare_risk r "
    "ON r.incident_id = i.incident_id LEFT JOIN c_latest_asc m ON m.incident_id = i.incident_id, c_as_of "
    "WHERE i.current_status <> 'RESTORED'"
)
_rationale = (
    "array_to_string(list_filter([CASE WHEN affected_gpu_count <> 0 OR estimated_capacity_risk_kw <> 0 THEN "
    "affected_gpu_count || ' affected GPUs and ' || printf('%.0f', estimated_capacity_risk_kw) || ' kW at risk' END, "
    "CASE WHEN redundancy_state = 'N-1' OR power_redundancy_lost OR cooling_redundancy_lost THEN redundancy_state || "
    "' redundancy exposure' END, CASE WHEN thermal_breach_minutes <> 0 THEN thermal_breach_minutes || "
    "' thermal breach minutes' END, CASE WHEN vendor_status NOT IN ('NOT_REQUIRED', 'ETA_CONFIRMED') THEN "
    "'vendor status ' || vendor_status END, CASE WHEN mitigation_status <> 'NONE' THEN 'mitigation ' || "
    "mitigation_status END], lambda x: x IS NOT NULL), '; ')"
)
SCORES = [
    "asset_criticality_score", "downtime_score", "stage_delay_score", "infrastructure_zone_impact_score",
    "needed_by_urgency_score", "repeat_failure_score", "spare_risk_score", "capacity_risk_score",
    "redundancy_risk_score", "thermal_risk_score", "vendor_eta_risk_score", "mitigation_credit_score",
]
CTES["c_totals"] = f"SELECT *, {' + '.join(SCORES[:-1])} - {SCORES[-1]} AS total, {_rationale} AS why FROM c_scored"
CTES["c_queue"] = (
    "SELECT incident_id, row_number() OVER (ORDER BY total DESC, incident_id) AS priority_rank, asset_id, zone_id, "
    f"current_stage, {', '.join(f'round({s}, 2) AS {s}' for s in SCORES)}, round(total, 2) AS total_priority_score, "
    "CASE current_stage WHEN 'FACILITIES_TRIAGE' THEN 'Complete facilities triage and confirm owning team' "
    "WHEN 'ENGINEER_ASSIGNED' THEN 'Assign facilities engineer or rebalance team' "
    "WHEN 'SPARE_VENDOR_WAITING' THEN CASE WHEN vendor_status = 'ETA_MISSED' THEN "
    "'Escalate missed vendor ETA and confirm recovery path' WHEN out_of_stock THEN "
    "'Expedite critical spare or vendor dispatch' ELSE 'Confirm spare availability or vendor ETA' END "
    "WHEN 'REPAIR_IN_PROGRESS' THEN 'Unblock repair completion and confirm mitigation status' "
    "WHEN 'VALIDATION' THEN 'Prioritize restore validation' ELSE 'Review infrastructure incident status' END "
    "AS recommended_action, (CASE WHEN is_delayed THEN criticality_level || ' asset in ' || zone_name || "
    "' is delayed in ' || current_stage || ' for ' || printf('%.1f', hours_in_current_stage) || ' hours.' ELSE "
    f"criticality_level || ' infrastructure incident is in ' || current_stage || ' and needed by ' || "
    f"{iso('needed_by_at')} || '.' END) || CASE WHEN coalesce(why, '') = '' THEN '' ELSE ' Impact rationale: ' || why "
    "|| '.' END AS reason_summary FROM c_totals"
)

# --- issues --------------------------------------------------------------------------------------------------

ISSUE_COLUMNS = "incident_id, asset_id, issue_type, severity, message, evidence_json"


def issue(source: str, where: str, kind: str, message: str, evidence: str, incident="incident_id", asset="NULL",
          severity="ERROR") -> str:
    text = message if message.startswith("CASE") else "'" + message + "'"
    return (
        f"SELECT CAST({incident} AS VARCHAR) AS incident_id, CAST({asset} AS VARCHAR) AS asset_id, '{kind}' AS "
        f"issue_type, '{severity}' AS severity, {text} AS message, {evidence} AS evidence_json "
        f"FROM {source} WHERE {where}"
    )


def outside(source: str, column: str, allowed, kind: str, message: str, keys=(), incident="NULL", asset="NULL") -> str:
    evidence = js(**{k: k for k in (*keys, column)})
    where = f"coalesce({column} NOT IN ({quoted(allowed)}), true)"
    return issue(source, where, f"workflow_ontology_{kind}", message, evidence, incident, asset)


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


NOT_PART = "is not part of the workflow ontology."
INVENTORY = "is not part of the infrastructure asset inventory."
_inc = lambda column, allowed, kind, noun: outside(
    "c_incidents", column, allowed, kind, f"The incident {noun} {NOT_PART}", (), "incident_id", "asset_id")
CTES["c_v_incident_vocabulary"] = union(
    _inc("current_stage", vocab.STAGES, "invalid_stage", "current stage"),
    _inc("current_status", vocab.INCIDENT_STATUSES, "invalid_status", "current status"),
    _inc("priority_level", vocab.LEVELS, "invalid_priority", "priority level"),
)
_evt = lambda column, allowed, kind, noun: outside(
    "c_events", column, allowed, kind, f"A stage event uses {noun} that {NOT_PART}", ("event_id",), "incident_id")
CTES["c_v_event_vocabulary"] = union(
    _evt("stage", vocab.STAGES, "invalid_stage", "a stage"),
    _evt("event_type", vocab.EVENT_TYPES, "invalid_event_type", "an event type"),
    _evt("event_status", vocab.EVENT_STATUSES, "invalid_event_status", "an event status"),
)
CTES["c_owned_snapshots"] = (
    "SELECT s.* EXCLUDE (asset_id), i.asset_id FROM c_snapshots s LEFT JOIN c_incidents i USING (incident_id)"
)
_imp = lambda column, allowed, kind, noun: outside(
    "c_owned_snapshots", column, allowed, kind, f"The impact snapshot {noun} {NOT_PART}", ("impact_snapshot_id",),
    "incident_id", "asset_id")
CTES["c_v_impact_vocabulary"] = union(
    _imp("redundancy_state", vocab.REDUNDANCY_STATES, "invalid_redundancy_state", "redundancy state"),
    _imp("mitigation_status", vocab.MITIGATIONS, "invalid_mitigation_status", "mitigation status"),
    _imp("vendor_status", vocab.VENDOR_STATUSES, "invalid_vendor_status", "vendor status"),
)
CTES["c_v_zone_vocabulary"] = union(
    outside("c_zones", "zone_priority", vocab.LEVELS, "invalid_zone_priority",
            f"The infrastructure zone priority {NOT_PART}", ("zone_id",)),
    outside("c_zones", "current_status", vocab.OPERATIONAL_STATUSES, "invalid_zone_status",
            f"The infrastructure zone status {NOT_PART}", ("zone_id",)),
)
CTES["c_v_asset_vocabulary"] = union(
    outside("c_assets", "criticality_level", vocab.LEVELS, "invalid_asset_criticality",
            f"The infrastructure asset criticality {NOT_PART}", ("asset_id",), "NULL", "asset_id"),
    outside("c_assets", "current_status", vocab.OPERATIONAL_STATUSES, "invalid_asset_status",
            f"The infrastructure asset status {NOT_PART}", ("asset_id",), "NULL", "asset_id"),
)
_dep = "c_dependencies"
CTES["c_v_dependency_vocabulary"] = union(
    issue(_dep, "dependent_asset_id = dependency_asset_id", "workflow_ontology_invalid_dependency_edge",
          "An infrastructure dependency cannot point an asset at itself.", js(dependency_id="dependency_id"), "NULL",
          "dependent_asset_id"),
    issue(_dep, "dependent_asset_id NOT IN (SELECT asset_id FROM c_assets)",
          "workflow_ontology_invalid_dependency_asset", f"The dependent asset {INVENTORY}",
          js(dependency_id="dependency_id"), "NULL", "dependent_asset_id"),
    issue(_dep, "dependency_asset_id NOT IN (SELECT asset_id FROM c_assets)",
          "workflow_ontology_invalid_dependency_asset", f"The dependency asset {INVENTORY}",
          js(dependency_id="dependency_id"), "NULL", "dependency_asset_id"),
    outside(_dep, "dependency_type", vocab.DEPENDENCY_TYPES, "invalid_dependency_type",
            f"The infrastructure dependency type {NOT_PART}", ("dependency_id",), "NULL", "dependent_asset_id"),
    outside(_dep, "dependency_role", vocab.DEPENDENCY_ROLES, "invalid_dependency_role",
            f"The infrastructure dependency role {NOT_PART}", ("dependency_id",), "NULL", "dependent_asset_id"),
)
CTES["c_v_spare_vocabulary"] = outside(
    "c_spares", "stock_status", vocab.STOCK_STATUSES, "invalid_spare_stock_status",
    f"The critical spare stock status {NOT_PART}", ("spare_id",))
CTES["c_v_work_order_vocabulary"] = outside(
    "c_work_orders", "work_order_status", vocab.WORK_ORDER_STATUSES, "invalid_work_order_status",
    f"The facility work order status {NOT_PART}", ("work_order_id",), "incident_id")
CTES["c_v_validation_vocabulary"] = outside(
    "c_validations", "validation_status", vocab.VALIDATION_STATUSES, "invalid_validation_status",
    f"The validation status {NOT_PART}", ("validation_id",), "incident_id")
CTES["c_v_telemetry_vocabulary"] = outside(
    "c_alerts", "severity", vocab.SEVERITIES, "invalid_telemetry_severity",
    f"The telemetry alert severity {NOT_PART}", ("telemetry_alert_id",), "linked_incident_id")


def _allowed(stage: str) -> list[str]:
    extra = [vocab.EXIT_EVENT[stage]] if stage in vocab.EXIT_EVENT else []
    extra += [vocab.VALIDATION_FAILED] if stage == "VALIDATION" else []
    return sorted([vocab.ENTERED, vocab.INCIDENT_RESTORED, *vocab.IMPACT_EVENTS, *extra])


CTES["c_allowed"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', [{quoted(_allowed(s))}])" for s in vocab.STAGES) + ") t(stage, allowed)"
CTES["c_entered"] = (
    f"SELECT * FROM c_events WHERE event_type = 'ENTERED_STAGE' AND stage IN ({quoted(vocab.STAGES)})")
CTES["c_v_stage_event_types"] = issue(
    "c_events JOIN c_allowed USING (stage)",
    f"event_type IN ({quoted(vocab.EVENT_TYPES)}) AND NOT list_contains(allowed, event_type)",
    "workflow_ontology_invalid_stage_event_type", "A stage event type is not allowed for the event stage.",
    js(event_id="event_id", stage="stage", event_type="event_type", allowed_event_types="allowed"))
CTES["c_v_duplicate_stage_entries"] = issue(
    "(SELECT incident_id, stage, list(event_id ORDER BY occurred_at, event_id) AS ids FROM c_entered GROUP BY 1, 2) t",
    "len(ids) > 1", "workflow_ontology_duplicate_stage_entry",
    "An incident has duplicate entered-stage evidence for a workflow stage.", js(stage="stage", event_count="len(ids)", first_event_id="ids[1]", last_event_id="ids[-1]"))
_place = lookup("stage", {s: i for i, s in enumerate(vocab.STAGES)})
CTES["c_steps"] = (
    f"SELECT *, {_place} AS place, lag(event_id) OVER w AS prev_id, lag(stage) OVER w AS prev_stage, "
    f"lag({_place}) OVER w AS prev_place FROM c_entered WINDOW w AS (PARTITION BY incident_id ORDER BY occurred_at, "
    "event_id)")
CTES["c_v_stage_progression"] = union(
    issue("c_steps", "prev_id IS NULL AND place <> 0", "workflow_ontology_invalid_stage_progression",
          "The incident did not enter the workflow through INCIDENT_REPORTED.", js(first_entered_stage="stage")),
    issue("c_steps", "prev_id IS NOT NULL AND place <> prev_place + 1", "workflow_ontology_invalid_stage_progression",
          "The incident entered workflow stages out of order or skipped a required stage.",
          js(previous_event_id="prev_id", previous_stage="prev_stage", current_event_id="event_id",
             current_stage="stage")),
)
CTES["c_terminal"] = (
    "SELECT i.incident_id, i.asset_id, i.current_status, list_sort(list_distinct(list(e.stage) FILTER (e.event_type = "
    "'ENTERED_STAGE'))) AS stages, count(*) FILTER (e.event_type = 'INCIDENT_RESTORED') AS restores, "
    "list(e.event_id ORDER BY e.occurred_at, e.event_id) FILTER (e.event_type = 'ENTERED_STAGE' AND e.stage = "
    f"'RESTORED') AS ids FROM c_events e JOIN c_incidents i USING (incident_id) WHERE e.stage IN "
    f"({quoted(vocab.STAGES)}) GROUP BY 1, 2, 3")
CTES["c_v_restored_state"] = union(
    issue("c_terminal", "current_status <> 'RESTORED' AND len(coalesce(ids, [])) > 0",
          "workflow_ontology_invalid_restored_state",
          "The incident is active but event history entered the terminal RESTORED stage.",
          js(current_status="current_status", event_count="len(ids)", first_event_id="ids[1]", last_event_id="ids[-1]"),
          asset="asset_id"),
    issue("c_terminal", "current_status = 'RESTORED' AND len(coalesce(ids, [])) = 0 AND restores = 0",
          "workflow_ontology_invalid_restored_state",
          "The incident is restored but has no terminal restore evidence.",
          js(current_status="current_status", entered_stages="coalesce(stages, [])",
             restored_event_count="restores"), asset="asset_id"),
)
CTES["c_evidence"] = (
    "SELECT incident_id, arg_max({'stage': stage, 'event_id': event_id}, occurred_at || event_id) FILTER (event_type = "
    "'ENTERED_STAGE') AS latest_entered, count(*) FILTER (event_type = 'INCIDENT_RESTORED') AS restore_count, "
    "list(event_id ORDER BY occurred_at, event_id) FILTER (event_type = 'INCIDENT_RESTORED') AS restore_ids, "
    f"arg_max({{'id': event_id, 'type': event_type, 'at': occurred_at}}, occurred_at || event_id) FILTER (event_type IN "
    f"({quoted(vocab.IMPACT_EVENTS)})) AS latest_impact, arg_max({{'id': event_id, 'type': event_type}}, occurred_at || "
    "event_id) FILTER (event_type IN ('REDUNDANCY_LOST', 'REDUNDANCY_RESTORED')) AS latest_redundancy, "
    "arg_max({'id': event_id, 'type': event_type}, occurred_at || event_id) FILTER (event_type IN ('VENDOR_ETA_UPDATED', "
    "'VENDOR_ETA_MISSED')) AS latest_vendor, min(occurred_at) FILTER (event_type = 'LOAD_SHIFTED') AS first_load_shift, "
    "min(occurred_at) FILTER (event_type = 'MITIGATION_APPLIED') AS first_mitigation FROM c_events GROUP BY incident_id")
CTES["c_seen"] = "SELECT i.*, e.* EXCLUDE (incident_id) FROM c_incidents i LEFT JOIN c_evidence e USING (incident_id)"
_state = "state_reconstruction_"
CTES["c_v_state_issues"] = union(
    issue("c_seen", "latest_entered IS NULL", _state + "missing_stage_event",
          "The incident has no entered-stage event, so the current stage cannot be reconstructed from event history.",
          js(current_stage="current_stage", current_status="current_status"), asset="asset_id"),
    issue("c_seen", "current_stage <> latest_entered.stage", _state + "stage_mismatch",
          "The core current stage does not match the latest entered-stage event.",
          js(core_current_stage="current_stage", latest_entered_stage="latest_entered.stage",
             latest_entered_event_id="latest_entered.event_id"), asset="asset_id"),
    issue("c_seen", "latest_entered IS NOT NULL AND current_status = 'RESTORED' AND restore_count = 0",
          _state + "missing_completion_event",
          "The incident is marked restored, but event history has no restore event.",
          js(current_status="current_status"), asset="asset_id"),
    issue("c_seen", "latest_entered IS NOT NULL AND current_status <> 'RESTORED' AND restore_count > 0",
          _state + "active_with_completion_event",
          "The incident is still active, but event history contains a restore event.",
          js(current_status="current_status", event_count="len(restore_ids)", first_event_id="restore_ids[1]",
             last_event_id="restore_ids[-1]"), asset="asset_id"),
)
CTES["c_v_event_sequence_issues"] = issue(
    "(SELECT incident_id, i.asset_id, i.reported_at, list(event_id ORDER BY occurred_at, event_id) AS ids FROM c_events e "
    "JOIN c_incidents i USING (incident_id) WHERE e.occurred_at < i.reported_at GROUP BY 1, 2, 3) t", "true",
    "event_sequence_before_request", "A stage event occurred before the infrastructure request was reported.",
    js(reported_at=iso("reported_at"), event_count="len(ids)", first_event_id="ids[1]", last_event_id="ids[-1]"),
    asset="asset_id")
CTES["c_v_spare_waiting_issues"] = issue(
    "(SELECT w.incident_id, i.asset_id, list(work_order_id ORDER BY work_order_id) AS ids FROM c_work_orders w "
    "LEFT JOIN c_incidents i USING (incident_id) WHERE work_order_status = 'WAITING_SPARE_VENDOR' AND "
    "coalesce(required_spare_id, '') = '' GROUP BY 1, 2) t", "true", "spare_waiting_missing_required_spare",
    "A work order is waiting on a spare or vendor, but no required spare is linked.",
    js(work_order_count="len(ids)", first_work_order_id="ids[1]", last_work_order_id="ids[-1]",
       work_order_status="'WAITING_SPARE_VENDOR'"), asset="asset_id")
_done = "SELECT incident_id FROM c_work_orders WHERE work_order_status IN ('REPAIR_COMPLETED', 'RESTORED')"
CTES["c_v_validation_issues"] = issue(
    "(SELECT v.*, i.asset_id FROM c_validations v LEFT JOIN c_incidents i USING (incident_id)) t",
    f"incident_id NOT IN ({_done})", "validation_without_completed_work",
    "A validation result exists before any completed infrastructure work is available.",
    js(validation_id="validation_id", validation_status="validation_status"), asset="asset_id")
CTES["c_v_output_issues"] = issue(
    "c_incidents", "incident_id NOT IN (SELECT incident_id FROM c_status)", "analytics_output_missing_current_status",
    "Analytics did not produce a current-status row for a core infrastructure incident.",
    js(current_stage="current_stage", current_status="current_status"), asset="asset_id")
CTES["c_impact_rows"] = (
    "SELECT i.incident_id, i.asset_id, i.priority_level, i.business_impact, i.current_stage, i.current_status, "
    "i.current_status <> 'RESTORED' AS active, s.impact_snapshot_id IS NOT NULL AS present, "
    "(priority_level IN ('CRITICAL', 'HIGH') OR regexp_matches(upper(business_impact), "
    f"'{vocab.HIGH_IMPACT_PATTERN}')) AS high, s.* EXCLUDE (incident_id, asset_id, zone_id), "
    "(redundancy_state IN ('N', 'N-1') OR power_redundancy_lost OR cooling_redundancy_lost) AS lost, "
    "e.* EXCLUDE (incident_id), as_of FROM c_incidents i LEFT JOIN c_latest_desc s USING (incident_id) LEFT JOIN "
    "c_evidence e USING (incident_id), c_as_of")


def _imp_issue(kind, where, message, evidence, severity="WARNING"):
    return issue("c_impact_rows", where, f"impact_{kind}", message, evidence, asset="asset_id", severity=severity)


_red = (
    "CASE WHEN latest_redundancy.type = 'REDUNDANCY_LOST' THEN 'Event history says redundancy was lost, but the latest "
    "impact snapshot still shows normal redundancy.' ELSE 'Event history says redundancy was restored, but the latest "
    "impact snapshot still shows redundancy loss.' END")
_exp = "CASE mitigation_status WHEN 'LOAD_SHIFTED' THEN 'LOAD_SHIFTED' ELSE 'MITIGATION_APPLIED' END"
CTES["c_v_impact_issues"] = union(
    _imp_issue("snapshot_missing_for_active_high_impact_incident", "active AND high AND NOT present",
               "The active high-impact incident has no impact snapshot, so capacity, redundancy, and vendor-risk context "
               "is unverified.",
               js(priority_level="priority_level", business_impact="business_impact", current_stage="current_stage"),
               "ERROR"),
    _imp_issue("snapshot_stale_after_latest_impact_event", "present AND active AND latest_impact.at > snapshot_at",
               "A material impact event occurred after the latest impact snapshot, so the displayed impact context may be "
               "stale.",
               js(latest_snapshot_id="impact_snapshot_id", latest_snapshot_at=iso("snapshot_at"),
                  latest_event_id="latest_impact.id", latest_event_type="latest_impact.type",
                  latest_event_at=iso("latest_impact.at"))),
    _imp_issue("redundancy_event_snapshot_mismatch",
               "present AND ((latest_redundancy.type = 'REDUNDANCY_LOST' AND NOT lost) OR (latest_redundancy.type = "
               "'REDUNDANCY_RESTORED' AND lost))", _red,
               js(latest_event_id="latest_redundancy.id", latest_event_type="latest_redundancy.type",
                  redundancy_state="redundancy_state", power_redundancy_lost="power_redundancy_lost",
                  cooling_redundancy_lost="cooling_redundancy_lost"), "ERROR"),
    _imp_issue("vendor_eta_event_snapshot_mismatch",
               "present AND latest_vendor.type = 'VENDOR_ETA_MISSED' AND vendor_status <> 'ETA_MISSED'",
               "Event history says the vendor ETA was missed, but the latest impact snapshot does not mark the vendor "
               "status as missed.",
               js(latest_event_id="latest_vendor.id", latest_event_type="latest_vendor.type",
                  vendor_status="vendor_status", vendor_eta_at=iso("vendor_eta_at")), "ERROR"),
    _imp_issue("vendor_eta_past_not_missed",
               "present AND active AND vendor_eta_at < as_of AND vendor_status IN ('ETA_CONFIRMED', "
               "'WAITING_VENDOR_DISPATCH')",
               "The vendor ETA is older than the analytics as-of time, but the impact snapshot has not marked the ETA as "
               "missed.",
               js(vendor_status="vendor_status", vendor_eta_at=iso("vendor_eta_at"), analytics_as_of=iso("as_of"))),
    _imp_issue("mitigation_without_event_evidence",
               "present AND mitigation_status IN ('LOAD_SHIFTED', 'RUNNING_DEGRADED') AND NOT EXISTS (SELECT 1 FROM "
               f"c_events x WHERE x.incident_id = c_impact_rows.incident_id AND x.event_type = {_exp} AND x.occurred_at "
               "<= snapshot_at)",
               "The impact snapshot reports mitigation, but event history has no matching mitigation evidence before the "
               "snapshot.",
               js(mitigation_status="mitigation_status", expected_event_type=_exp,
                  latest_snapshot_id="impact_snapshot_id", latest_snapshot_at=iso("snapshot_at"))),
    _imp_issue("thermal_context_missing_evidence",
               "present AND active AND thermal_breach_minutes > 0 AND upper(reading_status) NOT IN ('WARNING', 'CRITICAL')",
               "The impact snapshot reports thermal breach minutes, but no warning or critical telemetry reading is "
               "attached.",
               js(thermal_breach_minutes="thermal_breach_minutes", telemetry_reading_count="2",
                  latest_snapshot_id="impact_snapshot_id")),
    _imp_issue("capacity_risk_zero_for_critical_gpu_incident",
               "present AND active AND high AND affected_gpu_count = 0 AND estimated_capacity_risk_kw = 0 AND "
               "mitigation_status NOT IN ('LOAD_SHIFTED', 'RUNNING_DEGRADED')",
               "The incident is active and high impact, but the latest impact snapshot reports no affected GPU or capacity "
               "risk.",
               js(priority_level="priority_level", business_impact="business_impact",
                  affected_gpu_count="affected_gpu_count", estimated_capacity_risk_kw="estimated_capacity_risk_kw",
                  mitigation_status="mitigation_status")),
)
ISSUE_SETS = [
    "incident_vocabulary", "event_vocabulary", "impact_vocabulary", "stage_event_types", "duplicate_stage_entries",
    "stage_progression", "restored_state", "state_issues", "event_sequence_issues", "spare_waiting_issues",
    "validation_issues", "output_issues", "impact_issues",
]


def numbered(parts: list[str]) -> str:
    rows = union(*[f"SELECT {ISSUE_COLUMNS} FROM c_v_{p}" for p in parts])
    return (
        "SELECT 'REC-RUN-1-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS "
        "issue_id, 'RUN-1' AS pipeline_run_id, incident_id, asset_id, issue_type, severity, 'OPEN' AS status, message, "
        "evidence_json FROM (SELECT *, row_number() OVER (ORDER BY coalesce(incident_id, ''), issue_type, severity, "
        f"evidence_json, message) AS n FROM ({rows}) r) t"
    )


CTES["c_all_issues"] = numbered(ISSUE_SETS)


def behind(source: str, where: str, kind: str, record: str, stage="NULL") -> str:
    return (f"SELECT CAST(incident_id AS VARCHAR) AS incident_id, '{kind}' AS issue_type, CAST({stage} AS VARCHAR) AS stage, "
            f"CAST({record} AS VARCHAR) AS record_id FROM {source} WHERE {where}")


CTES["c_issue_evidence"] = union(
    behind("c_entered", "(incident_id, stage) IN (SELECT (incident_id, stage) FROM c_entered GROUP BY incident_id, stage "
           "HAVING count(*) > 1)", "workflow_ontology_duplicate_stage_entry", "event_id", "stage"),
    behind("c_terminal", "current_status <> 'RESTORED' AND len(coalesce(ids, [])) > 0",
           "workflow_ontology_invalid_restored_state", "unnest(ids)"),
    behind("c_seen", "latest_entered IS NOT NULL AND current_status <> 'RESTORED' AND restore_count > 0",
           _state + "active_with_completion_event", "unnest(restore_ids)"),
    behind("c_events e JOIN c_incidents i USING (incident_id)", "e.occurred_at < i.reported_at",
           "event_sequence_before_request", "event_id"),
    behind("c_work_orders", "work_order_status = 'WAITING_SPARE_VENDOR' AND coalesce(required_spare_id, '') = ''",
           "spare_waiting_missing_required_spare", "work_order_id"),
)
CTES["c_numbered_impact"] = numbered(["impact_issues"])
CTES["c_impact_counts"] = (
    "SELECT incident_id, count(*) AS impact_trust_issue_count FROM c_v_impact_issues GROUP BY incident_id")
_label = lookup("issue_type", vocab.ISSUE_LABELS, f"'{vocab.DEFAULT_ISSUE_LABEL}'")

# --- checks ---------------------------------------------------------------------------------------------------


def failing(number: int, source: str, where: str, key: str, rows: str = "1") -> str:
    return (
        f"SELECT {number} AS check_number, {key} AS failed_key, CAST({rows} AS BIGINT) AS failed_rows FROM {source} "
        f"WHERE {where}")


RECORD = "source_system || ':' || source_record_id"


def _raw_failures() -> str:
    parts = []
    for feed in RAW_FEEDS:
        source, table = f"c_raw_{feed.core}", feed.target_table
        parts.append(failing(check_number("unknown_source_system", table), source,
                             f"source_system <> '{vocab.SOURCE_SYSTEM}'", RECORD))
        parts.append(failing(
            check_number("duplicate_source_record", table),
            f"(SELECT source_system, source_record_id, count(*) - 1 AS n FROM {source} GROUP BY 1, 2) t", "n > 0",
            RECORD, "n"))
        names = ", ".join(
            f"CASE WHEN coalesce({_prefixed(f)}, '') = '' THEN '{f}' END" for f in sorted(feed.required))
        parts.append(failing(
            check_number("missing_required_fields", table),
            f"(SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS gone FROM {source}) t",
            "NOT is_object OR len(gone) > 0",
            f"CASE WHEN NOT is_object THEN {RECORD} ELSE {RECORD} || ' missing=' || array_to_string(gone, ',') END"))
        for field in feed.dates:
            parts.append(failing(check_number("invalid_date_format", table), source,
                                 f"is_object AND {field} = 'not-a-date'", f"{RECORD} || ' field={field}'"))
    for feed in RAW_FEEDS[1:]:
        field = "linked_incident_id" if feed.core == "alerts" else "incident_id"
        known = "SELECT incident_id FROM c_raw_incidents WHERE coalesce(incident_id, '') <> ''"
        where = f"{field} NOT IN ({known})" if feed.core == "alerts" else (
            f"({field} IS NULL OR {field} NOT IN ({known}))")
        parts.append(failing(check_number("missing_infrastructure_request_reference", feed.target_table),
                             f"c_raw_{feed.core}", where, RECORD))
    return union(*parts)


CTES["c_raw_failures"] = _raw_failures()


def _core_failures() -> str:
    simple = {
        "infrastructure_incident_without_stage_event": (
            "c_incidents", "incident_id NOT IN (SELECT incident_id FROM c_events)", "incident_id"),
        "stage_event_timestamp_out_of_order": (
            "c_events e JOIN c_incidents i USING (incident_id)", "e.occurred_at < i.reported_at", "event_id"),
        "work_order_without_request": (
            "c_work_orders", "incident_id NOT IN (SELECT incident_id FROM c_incidents)", "work_order_id"),
        "validation_without_completed_work": ("c_validations", f"incident_id NOT IN ({_done})", "validation_id"),
        "spare_waiting_without_required_spare": (
            "c_work_orders",
            "work_order_status = 'WAITING_SPARE_VENDOR' AND coalesce(required_spare_id, '') = ''", "work_order_id"),
        "telemetry_alert_without_known_asset": (
            "c_alerts", "asset_id NOT IN (SELECT asset_id FROM c_assets)", "telemetry_alert_id"),
    }
    by_issue = {
        "incident": ("incident_vocabulary", "incident_id"),
        "stage_event": ("event_vocabulary", "event_id"),
        "impact": ("impact_vocabulary", "impact_snapshot_id"),
        "zone": ("zone_vocabulary", "zone_id"),
        "asset": ("asset_vocabulary", "asset_id"),
        "dependency": ("dependency_vocabulary", "dependency_id"),
        "spare": ("spare_vocabulary", "spare_id"),
        "work_order": ("work_order_vocabulary", "work_order_id"),
        "validation": ("validation_vocabulary", "validation_id"),
        "telemetry": ("telemetry_vocabulary", "telemetry_alert_id"),
    }
    parts = []
    for number, (name, _, _, _) in list(enumerate(CHECKS, 1))[24:]:
        if name in simple:
            parts.append(failing(number, *simple[name]))
        elif name == "workflow_ontology_transition_rules":
            rows = union(*[f"SELECT {ISSUE_COLUMNS} FROM c_v_{p}" for p in (
                "stage_event_types", "duplicate_stage_entries", "stage_progression", "restored_state")])
            event = "coalesce(json_extract_string(evidence_json, '$.event_id'), '')"
            parts.append(failing(number, f"({rows}) t", "true",
                                 f"trim(incident_id || ' ' || issue_type || ' ' || {event})"))
        else:
            relation, field = by_issue[name.removeprefix("workflow_ontology_").removesuffix("_vocabulary")]
            subject = field if field == "incident_id" else f"json_extract_string(evidence_json, '$.{field}')"
            parts.append(failing(number, f"c_v_{relation}", "true", f"{subject} || ' ' || issue_type"))
    return union(*parts)


CTES["c_core_failures"] = _core_failures()
CTES["c_listing"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', '{t}', '{s}', '{msg}')" for i, (n, t, s, msg) in enumerate(CHECKS, 1)
) + ") t(check_number, check_name, target_table, severity, message)"


def check_rows(failures: str, where: str = "true") -> str:
    return (
        "SELECT 'DQ-RUN-1-' || lpad(CAST(l.check_number AS VARCHAR), 3, '0') AS check_result_id, 'RUN-1' AS "
        "pipeline_run_id, check_name, target_table, severity, CASE WHEN coalesce(n, 0) > 0 THEN 'FAILED' ELSE 'PASS' END "
        "AS status, CAST(coalesce(n, 0) AS BIGINT) AS failed_row_count, coalesce(keys, []) AS sample_failed_keys, message "
        f"FROM c_listing l LEFT JOIN (SELECT check_number, sum(failed_rows) AS n FROM ({failures}) f GROUP BY 1) t "
        "ON t.check_number = l.check_number LEFT JOIN (SELECT check_number, list(failed_key ORDER BY failed_key)[1:10] AS "
        f"keys FROM (SELECT check_number, failed_key, unnest(range(CAST(failed_rows AS BIGINT))) AS again FROM "
        f"({failures}) g) f GROUP BY 1) k ON k.check_number = l.check_number WHERE {where.replace('#', 'l.check_number')}"
    )


CTES["c_checks"] = check_rows("SELECT * FROM c_raw_failures UNION ALL SELECT * FROM c_core_failures")
CTES["c_core_checks"] = check_rows("SELECT * FROM c_core_failures", "# > 24")
CTES["c_ledger"] = (
    "SELECT 'RUN-' || strftime(reported_at, '%Y%m%d') AS pipeline_run_id, reported_at AS started_at, min(CASE WHEN "
    "current_status = 'PAUSED' THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END) AS status, count(*) AS rows_loaded "
    "FROM c_incidents GROUP BY reported_at")

# --- follow-up rows -----------------------------------------------------------------------------------------------

CTES["c_follow_ups"] = (
    "SELECT q.* EXCLUDE (current_stage), i.request_number, i.request_title, i.current_stage, i.current_status, "
    "i.needed_by_at, i.priority_level, i.business_impact, s.hours_in_current_stage, s.is_delayed, a.asset_name, "
    "a.criticality_level, z.zone_name, m.redundancy_state, coalesce(m.affected_gpu_count, 0) AS affected_gpu_count, "
    "coalesce(m.estimated_capacity_risk_kw, 0) AS estimated_capacity_risk_kw, m.mitigation_status, m.vendor_status, "
    "coalesce(c.impact_trust_issue_count, 0) AS impact_trust_issue_count, CASE WHEN m.impact_snapshot_id IS NULL THEN "
    "'UNVERIFIED' WHEN c.impact_trust_issue_count > 0 THEN 'WARNING' ELSE 'TRUSTED' END AS impact_confidence_status "
    "FROM c_queue q JOIN c_incidents i USING (incident_id) JOIN c_status s USING (incident_id) JOIN c_assets a ON "
    "a.asset_id = q.asset_id JOIN c_zones z ON z.zone_id = q.zone_id LEFT JOIN c_latest_desc m ON m.incident_id = "
    "q.incident_id LEFT JOIN c_impact_counts c ON c.incident_id = q.incident_id")
CTES["c_edges_named"] = (
    "SELECT d.dependency_id, d.dependent_asset_id, d.dependency_asset_id, d.dependency_type, d.dependency_role, "
    "d.impact_scope, a.asset_name AS dependent_asset_name, a.asset_type AS dependent_asset_type, a.current_status AS "
    "dependent_status, coalesce(x.n, 0) AS dependent_active_incident_count, b.asset_name AS dependency_asset_name, "
    "b.asset_type AS dependency_asset_type, b.current_status AS dependency_status, coalesce(y.n, 0) AS "
    "dependency_active_incident_count FROM c_dependencies d JOIN c_assets a ON a.asset_id = d.dependent_asset_id "
    "JOIN c_assets b ON b.asset_id = d.dependency_asset_id LEFT JOIN c_active x ON x.asset_id = d.dependent_asset_id "
    "LEFT JOIN c_active y ON y.asset_id = d.dependency_asset_id")
CTES["c_active"] = "SELECT asset_id, count(*) AS n FROM c_incidents WHERE current_status <> 'RESTORED' GROUP BY 1"

# --- graph ---------------------------------------------------------------------------------------------------------

CTES["c_links"] = (
    "SELECT DISTINCT dependency_asset_id AS up, dependent_asset_id AS asset FROM c_dependencies WHERE "
    "dependency_asset_id <> dependent_asset_id")
# The mapped dependencies form a tree, so a depth of 64 halvings covers any number of assets.
CTES["c_reach"] = (
    "SELECT DISTINCT origin, asset FROM (WITH RECURSIVE r(origin, asset) AS (SELECT up, asset FROM c_links UNION SELECT "
    "r.origin, l.asset FROM r JOIN c_links l ON l.up = r.asset) SELECT * FROM r) t WHERE origin <> asset")



def _enumerated(edges: str, most: int) -> str:
    """Paths from assets nothing depends on; a closing edge is listed, the asset it would repeat is not."""
    return (
        f"SELECT nodes[1] AS start_asset_id, nodes[-1] AS end_asset_id, nodes, ids AS dependency_ids, CAST(len(ids) AS INTEGER) AS "
        f"length, CASE WHEN closed THEN 'cycle' WHEN last IN (SELECT f FROM ({edges}) x) THEN 'limit' ELSE 'root' END AS "
        "ended, (SELECT CAST(coalesce(sum(a.n), 0) AS BIGINT) FROM c_active a WHERE list_contains(p.nodes, a.asset_id)) AS "
        "active_incident_count FROM (WITH RECURSIVE r(nodes, ids, last, closed) AS (SELECT [f], CAST([] AS VARCHAR[]), f, "
        f"false FROM (SELECT DISTINCT f FROM ({edges}) e WHERE f NOT IN (SELECT t FROM ({edges}) g)) s UNION ALL SELECT CASE "
        "WHEN list_contains(r.nodes, e.t) THEN r.nodes ELSE list_append(r.nodes, e.t) END, list_append(r.ids, e.id), e.t, "
        f"list_contains(r.nodes, e.t) FROM r JOIN ({edges}) e ON e.f = r.last WHERE NOT r.closed AND len(r.ids) < {most}) "
        f"SELECT * FROM r) p WHERE closed OR len(ids) = {most} OR last NOT IN (SELECT f FROM ({edges}) y)"
    )


_path_edges = (
    "SELECT dependent_asset_id AS f, {} AS t, dependency_id AS id FROM c_dependencies WHERE dependent_asset_id <> {}")
_ring = "CASE WHEN dependent_asset_id = dependency_asset_id THEN 'ASSET-3' ELSE dependency_asset_id END"
CTES["c_edges_up"] = _path_edges.format("dependency_asset_id", "dependency_asset_id")
CTES["c_edges_ring"] = _path_edges.format(_ring, _ring)

from faultline.operators import findings as fnd  # noqa: E402
from faultline.operators import graph as grf  # noqa: E402
from faultline.operators import shapes as shp  # noqa: E402

NS, XSD, TYPE, ONT, PROV = grf.RUNTIME, grf.XSD, grf.RDF_TYPE, shp.ONTOLOGY, shp.PROV


def _iri(column: str) -> str:
    return f"'{NS}' || regexp_replace(trim({column}), '[^A-Za-z0-9_-]', '-', 'g')"


def _facts(source: str, subject: str, *facts: tuple) -> str:
    return union(*[
        f"SELECT {_iri(subject)} AS s, '{p}' AS p, CAST({o} AS VARCHAR) AS o, '{kind}' AS o_kind, "
        + (f"'{XSD}{dtype}'" if dtype else "CAST(NULL AS VARCHAR)") + f" AS o_datatype FROM {source}"
        for p, o, kind, dtype in facts
    ])


def _t(name, column, dtype="string"):
    return (name if name.startswith("http") else NS + name, column, "literal", dtype)


def _l(name, column):
    return (NS + name, _iri(column), "iri", None)


def _a(name):
    return (TYPE, f"'{NS}{name}'", "iri", None)


LABEL = grf.RDFS + "label"
CTES["c_core_triples"] = "SELECT DISTINCT * FROM (" + union(
    _facts("c_zones", "zone_id", _a("Zone"), _t(LABEL, "zone_name"), _t("zonePriority", "zone_priority"),
           _t("hasCurrentStatus", "current_status")),
    _facts("c_assets", "asset_id", _a("Asset"), _t(LABEL, "asset_name"), _t("assetType", "asset_type"),
           _t("criticalityLevel", "criticality_level"), _t("hasCurrentStatus", "current_status"),
           _l("locatedIn", "zone_id")),
    _facts("c_dependencies", "dependency_id", _a("Dependency"),
           _t(LABEL, "dependent_asset_id || ' depends on ' || dependency_asset_id || ' via ' || dependency_type"),
           _l("dependentAsset", "dependent_asset_id"), _l("dependsOn", "dependency_asset_id"),
           _l("downstreamAsset", "dependent_asset_id"), _l("upstreamAsset", "dependency_asset_id"),
           _t("hasDependencyType", "dependency_type"), _t("dependencyRole", "dependency_role"),
           _t("impactScope", "impact_scope")),
    _facts("c_incidents", "incident_id", _a("Incident"), _t(LABEL, "request_title"), _l("affectsAsset", "asset_id"),
           _t("hasCurrentStatus", "current_status"), _t("workflowStage", "current_stage"),
           _t("priorityLevel", "priority_level"), _t("businessImpact", "business_impact")),
    _facts("c_latest_asc", "impact_snapshot_id", _a("ImpactSnapshot"),
           _t("estimatedCapacityRiskKw", "estimated_capacity_risk_kw", "decimal"),
           _t("affectedGpuCount", "affected_gpu_count", "integer"), _t("redundancyState", "redundancy_state"),
           _t("mitigationStatus", "mitigation_status"), _t("vendorStatus", "vendor_status")),
    _facts("c_latest_asc", "incident_id", _l("hasImpactSnapshot", "impact_snapshot_id")),
) + ") t WHERE o IS NOT NULL"
CTES["c_trust_triples"] = union(
    _facts("c_all_issues", "issue_id", _a("TrustIssue"), _t(LABEL, "message"), _t("confidenceStatus", "severity")),
    _facts("c_all_issues", "incident_id", _l("hasTrustIssue", "issue_id")),
)
CTES["c_broken"] = (
    f"SELECT * FROM c_core_triples WHERE NOT (p = '{NS}dependencyRole' AND o = 'TERTIARY') AND NOT "
    f"(p = '{NS}workflowStage' AND o = 'UNKNOWN_STAGE')")

# Facts of the contract vocabulary. No id of the model needs escaping apart from the "/" in source addresses.
_enc = lambda text: f"replace({text}, '/', '%2F')"


def _node(kind: str, column: str) -> str:
    return f"'urn:dcai:canonical:{kind}:' || {_enc(column)}"


def _canon(source: str, kind: str, key: str, *facts: tuple[str, str, str | None, str]) -> str:
    rows = [*facts, ("hasIdentifier", key, "string", "true"),
            ("prov:wasDerivedFrom", _node("source", f"'{kind}/' || {key}"), None, "true")]
    out = []
    for p, o, dtype, where in rows:
        full = TYPE if p == "type" else PROV + p[5:] if p.startswith("prov:") else ONT + p
        dt = f"'{XSD}{dtype}'" if dtype else "CAST(NULL AS VARCHAR)"
        out.append(f"SELECT {_node(kind, key)} AS s, '{full}' AS p, CAST({o} AS VARCHAR) AS o, "
                   f"'{'literal' if dtype else 'iri'}' AS o_kind, {dt} AS o_datatype FROM {source} WHERE {where}")
    return union(*out)


_known = f"current_stage IN ({quoted(vocab.STAGES)})"
_paths = {"POWER_PATH": "PowerPath", "COOLING_PATH": "CoolingPath", "CONTROL_TELEMETRY": "TelemetryPath",
          "REDUNDANCY_SUPPORT": "RedundancyPath"}
_is = lambda name: ("type", f"'{ONT}{name}'", None, "true")
CTES["c_canon"] = "SELECT DISTINCT * FROM (" + union(
    _canon("c_zones", "zone", "zone_id", _is("InfrastructureZone")),
    _canon("c_assets", "asset", "asset_id", _is("InfrastructureAsset"),
           ("locatedIn", _node("zone", "zone_id"), None, "true"), ("hasAssetType", "asset_type", "string", "true"),
           ("hasCriticalityLevel", "criticality_level", "string", "true")),
    _canon("c_incidents", "incident", "incident_id", _is("InfrastructureIncident"),
           ("affectsAsset", _node("asset", "asset_id"), None, "true"),
           ("hasCurrentStage", _node("stage", "current_stage"), None, _known),
           ("hasCurrentStage", "current_stage", "string", f"NOT {_known}")),
    _canon("c_dependencies", "edge", "dependency_id", _is("DependencyEdge"),
           ("hasDependentAsset", _node("asset", "dependent_asset_id"), None, "true"),
           ("hasDependencyAsset", _node("asset", "dependency_asset_id"), None, "true"),
           ("hasDependencyRole", "dependency_role", "string", "true")),
    _canon("c_snapshots", "impact", "impact_snapshot_id", _is("ImpactObservation"),
           ("impactForIncident", _node("incident", "incident_id"), None, "true"),
           ("estimatedCapacityRiskKw", "CAST(estimated_capacity_risk_kw AS DECIMAL(18, 2))", "decimal", "true"),
           ("affectedGpuCount", "affected_gpu_count", "integer", "true")),
    _canon("c_alerts", "evidence", "telemetry_alert_id", _is("TelemetryEvidence"),
           ("supportsFact", _node("incident", "linked_incident_id"), None, "coalesce(linked_incident_id, '') <> ''")),
    _canon(f"(SELECT *, dependency_type || '/' || impact_scope AS path_id FROM c_dependencies WHERE dependency_type IN "
           f"({quoted(_paths)})) t", "path", "path_id",
           *[("type", f"'{ONT}{c}'", None, f"dependency_type = '{t}'") for t, c in _paths.items()],
           ("hasPathStep", _node("edge", "dependency_id"), None, "true")),
    f"SELECT DISTINCT {_node('stage', 'current_stage')} AS s, '{TYPE}' AS p, '{ONT}WorkflowStage' AS o, 'iri' AS o_kind, "
    f"CAST(NULL AS VARCHAR) AS o_datatype FROM c_incidents WHERE {_known}",
) + ") t"
CTES["c_parents"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{ONT}{c}', '{ONT}{p}')" for c, p in shp.CONTRACT_PARENT.items()) + ") t(child, parent)"
CTES["c_above"] = (
    "SELECT * FROM (WITH RECURSIVE up(child, parent) AS (SELECT child, parent FROM c_parents UNION SELECT up.child, "
    "c_parents.parent FROM up JOIN c_parents ON c_parents.child = up.parent) SELECT * FROM up) t")
CTES["c_property_classes"] = "SELECT * FROM (VALUES " + ", ".join(
    [f"('domain', '{ONT}{p}', '{ONT}{c}')" for p, c in shp.CONTRACT_DOMAIN.items()]
    + [f"('range', '{ONT}{p}', '{ONT}{c}')" for p, c in shp.CONTRACT_RANGE.items()]) + ") t(side, p, class)"
CTES["c_direct_types"] = (
    f"SELECT s AS node, o AS class FROM c_canon WHERE p = '{TYPE}' UNION SELECT s, class FROM c_canon JOIN "
    "c_property_classes USING (p) WHERE side = 'domain' UNION SELECT o, class FROM c_canon JOIN c_property_classes "
    "USING (p) WHERE side = 'range' AND o_kind = 'iri'")
CTES["c_types"] = (
    "SELECT node, class FROM c_direct_types UNION SELECT node, parent FROM c_direct_types JOIN c_above ON child = class")


def report(triples: str, types: str, shapes: shp.ShapeSet) -> str:
    name = lambda x: f"CASE WHEN contains({x}, '#') THEN split_part({x}, '#', -1) ELSE split_part({x}, '/', -1) END"
    parts = []

    def add(focus, path, component, value, message, source):
        parts.append(f"SELECT {focus} AS focus, {path} AS path, '{component}' AS component, {value} AS value, "
                     f"'{message}' AS message FROM {source}")

    for target, path, least, most, dtype, cls in shapes.constraints:
        t, p = shapes.full(target), shapes.full(path)
        members = f"(SELECT node FROM {types} WHERE class = '{t}') f"
        counted = f"{members} LEFT JOIN (SELECT s, count(*) AS n FROM {triples} WHERE p = '{p}' GROUP BY s) v ON s = node"
        if least:
            add("node", f"'{p}'", "minCount", "NULL", f"fewer than {least} values",
                f"{counted} WHERE coalesce(n, 0) < {least}")
        if most is not None:
            add("node", f"'{p}'", "maxCount", "NULL", f"more than {most} values", f"{counted} WHERE n > {most}")
        values = f"{members} JOIN (SELECT * FROM {triples} WHERE p = '{p}') v ON s = node"
        if dtype:
            add("node", f"'{p}'", "datatype", "o", f"value is not of type {dtype}",
                f"{values} WHERE o_kind <> 'literal' OR coalesce(o_datatype, '') <> '{XSD}{dtype}'")
        if cls:
            add("node", f"'{p}'", "class", "o", f"value is not a {local(shapes.full(cls))}",
                f"{values} WHERE o_kind <> 'iri' OR o NOT IN (SELECT node FROM {types} WHERE class = "
                f"'{shapes.full(cls)}')")
    for target, options in shapes.alternatives.items():
        met = union(*[
            f"SELECT s FROM {triples} WHERE p = '{shapes.full(p)}' GROUP BY s"
            + (f" HAVING bool_and(o IN (SELECT node FROM {types} WHERE class = '{shapes.full(c)}'))" if c else "")
            for p, c in options])
        add("node", "NULL", "or", "NULL", "needs " + " or ".join(p for p, _ in options),
            f"(SELECT node FROM {types} WHERE class = '{shapes.full(target)}') f WHERE node NOT IN ({met})")
    # Several shapes may ask the same count of one focus and path: one result for each.
    return f"SELECT DISTINCT {name('focus')} AS focus_node, {name('path')} AS result_path, component, value, message, " \
           f"'Violation' AS severity FROM ({union(*parts)}) t"


def local(address: str) -> str:
    return address.rsplit("#", 1)[1] if "#" in address else address.rsplit("/", 1)[-1]


CTES["c_runtime_types"] = (
    f"SELECT s AS node, o AS class FROM c_broken WHERE p = '{TYPE}' UNION "
    + " UNION ".join(f"SELECT s, '{NS}{c}' FROM c_broken WHERE p = '{NS}{p}'" for p, c in shp.RUNTIME_DOMAIN.items())
    + " UNION "
    + " UNION ".join(f"SELECT o, '{NS}{c}' FROM c_broken WHERE p = '{NS}{p}'" for p, c in shp.RUNTIME_RANGE.items()))
CTES["c_full_types"] = CTES["c_runtime_types"].replace("c_broken", "c_core_triples")
CTES["c_contract_report"] = report("c_canon", "c_types", shp.CONTRACT_SHAPES)


def find(kind: str, finding_type: str, about: str, text: str, source: str, *derived: str) -> str:
    encoded = f"replace({about}, ':', '%3A')"
    return " UNION ".join(
        f"SELECT '{fnd.FINDING_IRI}{kind}:' || {encoded} AS finding, '{finding_type}' AS finding_type, {text} AS text, "
        f"{d} AS derived_from FROM {source}" for d in derived)


def p_(predicate: str, s: str, o: str) -> str:
    return f"(SELECT s AS {s}, o AS {o} FROM c_canon WHERE p = '{ONT}{predicate}')"


CTES["c_inc_assets"] = (
    f"SELECT incident, asset FROM {p_('affectsAsset', 'incident', 'asset')} a WHERE incident IN (SELECT node FROM "
    f"c_types WHERE class = '{ONT}InfrastructureIncident')")
CTES["c_inc_stages"] = (
    f"SELECT incident, stage FROM {p_('hasCurrentStage', 'incident', 'stage')} a WHERE incident IN (SELECT node FROM "
    f"c_types WHERE class = '{ONT}InfrastructureIncident')")
CTES["c_path_edges"] = (
    f"SELECT DISTINCT path, dependent, dependency FROM {p_('hasPathStep', 'path', 'edge')} a JOIN "
    f"{p_('hasDependentAsset', 'edge', 'dependent')} b USING (edge) JOIN {p_('hasDependencyAsset', 'edge', 'dependency')} c "
    f"USING (edge) WHERE path IN (SELECT node FROM c_types WHERE class = '{ONT}DependencyPath')")
CTES["c_f_exposure"] = find(
    "dependency-exposure", "DependencyImpactFinding", "incident",
    "'Dependency exposure from ' || asset || ' through ' || dependency",
    "c_inc_assets JOIN c_path_edges ON dependent = asset", "incident", "path")
CTES["c_f_blast"] = find(
    "blast-radius", "BlastRadiusFinding", "incident",
    "'Blast radius placeholder from ' || asset || ' to ' || dependent",
    "c_inc_assets JOIN c_path_edges ON dependency = asset", "incident", "path")
CTES["c_f_blocker"] = find(
    "recovery-blocker", "RecoveryBlocker", "incident", "'Current recovery blocker is stage ' || stage", "c_inc_stages",
    "incident") + " UNION " + find(
    "follow-up-decision", "FollowUpDecision", "incident", "'Follow up the active blocker for ' || incident",
    "c_inc_stages", "incident")
CTES["c_f_readiness"] = find(
    "restore-readiness", "RestoreReadinessFinding", "incident",
    "'Restore readiness placeholder for ' || incident || ' at stage ' || stage", "c_inc_stages", "incident")
CTES["c_f_trust"] = find(
    "impact-trust", "TrustFinding", "impact", "'Impact trust placeholder for ' || impact",
    f"(SELECT DISTINCT impact FROM {p_('impactForIncident', 'impact', 'incident')} a WHERE impact IN (SELECT node FROM "
    f"c_types WHERE class = '{ONT}ImpactObservation')) t", "impact")
_activity = "urn:dcai:activity:RUN-1"
CTES["c_findings"] = (
    "SELECT finding, finding_type, CASE WHEN finding[-1] = '3' THEN '' ELSE text END AS text, CASE WHEN finding[-1] <> '7' "
    "THEN derived_from END AS derived_from FROM (SELECT * FROM c_f_exposure UNION ALL SELECT * FROM c_f_blast UNION ALL "
    "SELECT * FROM c_f_blocker UNION ALL SELECT * FROM c_f_readiness UNION ALL SELECT * FROM c_f_trust) t")
CTES["c_provenance"] = (
    f"SELECT finding AS s, '{PROV}wasDerivedFrom' AS p, derived_from AS o FROM c_findings WHERE derived_from IS NOT NULL "
    f"UNION SELECT finding, '{PROV}wasGeneratedBy', '{_activity}' FROM c_findings WHERE finding_type <> 'TrustFinding' UNION "
    f"SELECT '{_activity}', '{PROV}generated', finding FROM c_findings WHERE finding_type <> 'TrustFinding' UNION SELECT "
    f"'{_activity}', '{PROV}used', derived_from FROM c_findings WHERE finding_type <> 'TrustFinding' AND derived_from IS NOT "
    "NULL")

_quality_flags = (
    "SELECT DISTINCT i.incident_id, 1 AS flag_source, check_result_id AS sort_key, target_table || '.' || "
    "check_name || ': ' || message AS flag FROM (SELECT *, unnest(sample_failed_keys) AS key FROM c_checks WHERE status "
    "<> 'PASS') k JOIN c_incidents i ON contains(k.key, i.incident_id) UNION ALL SELECT incident_id, 2, severity || ' ' || "
    f"issue_type, {_label} || ': ' || message FROM c_all_issues WHERE issue_type NOT IN ({quoted(vocab.IMPACT_ISSUES)}) AND "
    "incident_id IN (SELECT incident_id FROM c_incidents)")
CTES["c_quality_flags"] = _quality_flags
CTES["c_detail"] = (
    "SELECT incident_id, 0 AS section, CAST(entered_at AS VARCHAR) AS a, event_id AS b, "
    + js(event_id="event_id", stage="stage", entered_at=iso("entered_at"), exited_at=iso("exited_at"),
         duration_hours="round(hours, 2)", delay_hours="round(delay_hours, 2)", is_bottleneck="is_bottleneck")
    + " AS item FROM c_leads UNION ALL SELECT incident_id, 1, CAST(occurred_at AS VARCHAR), event_id, "
    + js(event_id="event_id", stage="stage", event_type="event_type", event_status="event_status",
         occurred_at=iso("occurred_at"), message="json_extract_string(metadata_json, '$.message')")
    + " FROM c_events UNION ALL SELECT incident_id, 2, work_order_id, work_order_id, "
    + js(work_order_id="work_order_id", assigned_team="assigned_team", work_order_status="work_order_status",
         required_spare_name="s.spare_name", stock_status="s.stock_status")
    + " FROM c_work_orders w LEFT JOIN c_spares s ON s.spare_id = w.required_spare_id UNION ALL SELECT incident_id, 3, "
    "validation_id, validation_id, "
    + js(validation_id="validation_id", validation_status="validation_status", failure_reason="failure_reason")
    + " FROM c_validations UNION ALL SELECT linked_incident_id, 4, telemetry_alert_id, telemetry_alert_id, "
    + js(telemetry_alert_id="telemetry_alert_id", alert_type="alert_type", severity="severity",
         triggered_at="CASE WHEN epoch_us(triggered_at) % 1000000 = 0 THEN " + iso("triggered_at")
         + " ELSE strftime(triggered_at, '%Y-%m-%dT%H:%M:%S.%f') END")
    + " FROM c_alerts WHERE linked_incident_id IS NOT NULL UNION ALL SELECT incident_id, 5, impact_snapshot_id, "
    "impact_snapshot_id, "
    + js(impact_snapshot_id="impact_snapshot_id", snapshot_at=iso("snapshot_at"), redundancy_state="redundancy_state",
         vendor_status="vendor_status", mitigation_status="mitigation_status", affected_gpu_count="affected_gpu_count")
    + " FROM c_latest_asc UNION ALL SELECT incident_id, 6, CAST(flag_source AS VARCHAR), sort_key, "
    + js(source="CAST(flag_source AS VARCHAR)", kind="sort_key", text="flag")
    + " FROM (SELECT incident_id, 3 AS flag_source, severity || ' ' || issue_type AS sort_key, message AS flag FROM "
    "c_v_impact_issues) f"
)
_sections = ["stage_lead_times", "timeline", "work_orders", "validations", "alerts", "impact_snapshot", "flags"]

# --- final selects -----------------------------------------------------------------------------------------------

_ordered_core = {
    name: schemas.column_names(schemas.CORE[name]) for name in ("incidents", "events", "work_orders", "validations",
                                                                "alerts")
}


def _core_select(name: str) -> str:
    """Accepted rows with their model types: the clean feed keeps text, so values come from the model table."""
    key = schemas.PRIMARY_KEY[name]
    source = "c_candidates" if name == "incidents" else f"c_{name}"
    columns_ = ", ".join(f"t.{c}" for c in _ordered_core[name])
    return f"SELECT {columns_} FROM {source} t WHERE {key} IN (SELECT {key} FROM c_accepted_{name})"


def _feeds(template: str) -> str:
    return union(*[template.replace("{}", f.core) for f in RAW_FEEDS])


FINAL: dict[str, str] = {
    "raw_load_rows": _feeds("SELECT '{}' AS feed, source_system, source_record_id, position FROM c_loaded_raw_{}"),
    "raw_load_rejects": _feeds("SELECT * FROM c_unloaded_raw_{}"),
    "raw_load_second_run": _feeds(
        "SELECT '{}' AS feed, 0 AS rows_loaded, count(*) AS rows_rejected FROM c_raw_{}"),
    **{f"core_{name}": _core_select(name) for name in _ordered_core},
    "core_load_counts": _feeds(
        "SELECT '{}' AS feed, (SELECT count(*) FROM c_accepted_{}) AS records_loaded, (SELECT count(*) FROM "
        "c_loaded_clean_{}) - (SELECT count(*) FROM c_accepted_{}) AS records_skipped"),
    "incremental_load_counts": "SELECT * FROM c_two_runs",
    "incremental_ledger": "SELECT pipeline_run_id, CASE WHEN sum(rows_rejected) = 0 THEN 'SUCCESS' ELSE 'PARTIAL_SUCCESS' END "
    "AS status, CAST(sum(rows_loaded) AS BIGINT) AS rows_loaded, CAST(sum(rows_rejected) AS BIGINT) AS rows_rejected, "
    "CAST(sum(sum(rows_accepted)) OVER (ORDER BY pipeline_run_id) AS BIGINT) AS core_records_loaded, "
    "CAST(sum(rows_waiting) AS BIGINT) AS core_records_skipped FROM c_two_runs GROUP BY 1",
    "incremental_work_orders": _core_select("work_orders"),
    "core_snapshots": "SELECT s.* EXCLUDE (reading_status) FROM c_snapshots s WHERE incident_id IN (SELECT incident_id "
    "FROM c_incidents) AND asset_id IN (SELECT asset_id FROM c_assets) AND zone_id IN (SELECT zone_id FROM c_zones)",
    "known_dependency_edges": "SELECT * FROM c_dependencies WHERE dependent_asset_id IN (SELECT asset_id FROM c_assets) "
    "AND dependency_asset_id IN (SELECT asset_id FROM c_assets)",
    "upsert_spares": "SELECT * REPLACE (CASE WHEN critical_spare THEN 'IN_STOCK' ELSE stock_status END AS stock_status) "
    "FROM c_spares",
    "analytics_as_of": "SELECT max(occurred_at) AS last_event_at, any_value(as_of) AS as_of FROM c_events, c_as_of",
    "stage_lead_times": "SELECT incident_id, event_id, stage, entered_at, exited_at, hours AS duration_hours, "
    "threshold_hours, delay_hours, is_bottleneck FROM c_leads",
    "lead_profile": "SELECT * FROM c_profile",
    "latest_snapshots_smallest_id": "SELECT incident_id, impact_snapshot_id, snapshot_at FROM c_latest_asc",
    "latest_snapshots_largest_id": "SELECT incident_id, impact_snapshot_id, snapshot_at FROM c_latest_desc",
    "event_profile": "SELECT incident_id, latest_entered.stage AS latest_stage, latest_entered.event_id AS "
    "latest_stage_event, restore_count, latest_impact.id AS latest_impact_event, latest_redundancy.type AS "
    "latest_redundancy_type, latest_vendor.type AS latest_vendor_type, first_load_shift, first_mitigation FROM c_evidence",
    "current_status": "SELECT * FROM c_status",
    "bottleneck_summary": "SELECT * FROM c_bottlenecks",
    "stage_downtime": "SELECT * EXCLUDE (summary_date, dimension_type, dimension_id) FROM c_bottlenecks WHERE "
    "dimension_type = 'STAGE'",
    "asset_delay_summary": "SELECT * FROM c_asset_delays",
    "zone_delay_summary": "SELECT * FROM c_zone_delays",
    "spare_waiting_summary": "SELECT * FROM c_spare_waits",
    "worst_assets": "SELECT * FROM c_asset_delays ORDER BY total_downtime_hours DESC, asset_name LIMIT 20",
    "worst_zones": "SELECT * FROM c_zone_delays",
    "longest_spare_waits": "SELECT * FROM c_spare_waits",
    "asset_incident_counts": "SELECT i.asset_id, count(*) AS incident_count, any_value(a.n) AS active_incident_count "
    "FROM c_incidents i LEFT JOIN c_active a USING (asset_id) GROUP BY 1",
    "spare_risk": "SELECT incident_id, CAST(spare_risk AS DOUBLE) AS spare_risk, out_of_stock AS "
    "needs_out_of_stock_spare FROM c_spare_risk",
    "score_components": f"SELECT incident_id, {', '.join(f'round({s}, 6) AS {s}' for s in SCORES)} FROM c_scored",
    "follow_up_queue": "SELECT * FROM c_queue",
    "follow_up_rows": "SELECT * FROM c_follow_ups",
    "follow_ups_filtered": "SELECT priority_rank, incident_id, zone_id, current_stage, total_priority_score FROM "
    "c_follow_ups WHERE is_delayed AND criticality_level = 'CRITICAL' AND estimated_capacity_risk_kw > 0 AND "
    "affected_gpu_count > 0 AND impact_confidence_status IN ('WARNING', 'UNVERIFIED') ORDER BY priority_rank LIMIT 50",
    "follow_ups_vendor_missed": "SELECT priority_rank, incident_id, redundancy_state, vendor_status FROM c_follow_ups "
    "WHERE redundancy_state = 'N-1' AND vendor_status = 'ETA_MISSED'",
    "contracts": union(*[
        f"SELECT '{feed.source_name}' AS source_name, '{feed.target_table}' AS target_table, {len(feed.required)} AS required, "
        f"count(*) AS records FROM c_{feed.core}" for feed in (*RAW_FEEDS, TOPOLOGY_FEED)]),
    "queue_scope_sizes": union(*[
        f"SELECT '{name}' AS scope, count(*) FILTER ({where}) AS queue_items FROM c_follow_ups" for name, where in {
            "all": "true",
            "critical-asset-delay": "is_delayed AND criticality_level = 'CRITICAL'",
            "vendor-eta-missed": "vendor_status = 'ETA_MISSED'",
            "spare-vendor-wait": "current_stage = 'SPARE_VENDOR_WAITING'",
            "evidence-review": "impact_confidence_status <> 'TRUSTED'",
            "n-1-exposure": "redundancy_state = 'N-1'",
        }.items()]),
    "queue_summary": "SELECT count(*) AS queue_items, count(*) FILTER (hours_in_current_stage > 0) AS delayed_items, "
    "count(*) FILTER (priority_level = 'CRITICAL') AS critical_priority_items, sum(estimated_capacity_risk_kw) AS "
    "capacity_risk_kw, CAST(sum(affected_gpu_count) AS BIGINT) AS affected_gpu_count, count(*) FILTER (redundancy_state = "
    "'N-1') AS n1_exposure_items, count(*) FILTER (vendor_status = 'ETA_MISSED') AS vendor_eta_missed_items, count(*) "
    "FILTER (current_stage = 'SPARE_VENDOR_WAITING') AS spare_vendor_wait_items, sum(hours_in_current_stage) FILTER "
    "(current_stage = 'SPARE_VENDOR_WAITING') AS spare_vendor_wait_hours, count(*) FILTER (impact_confidence_status <> "
    "'TRUSTED') AS evidence_review_items, (SELECT "
    + lookup("current_stage", {s: s.replace("_", " ").title() for s in [*vocab.STAGES, "UNKNOWN_STAGE"]})
    + " FROM c_follow_ups GROUP BY current_stage ORDER BY sum(hours_in_current_stage) DESC, count(*) DESC, current_stage "
    "LIMIT 1) AS top_blocker, CASE WHEN count(*) FILTER (redundancy_state = 'N-1') > 0 AND count(*) FILTER "
    "(vendor_status = 'ETA_MISSED') > 0 THEN 'N-1 + missed ETA' ELSE 'other' END AS primary_risk FROM c_follow_ups",
    "incident_headers": "SELECT s.incident_id, coalesce(q.priority_rank, 0) AS priority_rank, "
    "coalesce(q.total_priority_score, 0) AS total_priority_score, coalesce(q.recommended_action, CASE WHEN "
    "s.current_status = 'RESTORED' THEN 'No follow-up required' ELSE 'Review infrastructure incident status' END) AS "
    "recommended_action, coalesce(q.reason_summary, 'Incident is ' || s.current_status || ' in ' || s.current_stage || "
    "'.') AS reason_summary, a.asset_name, z.zone_name, CASE WHEN m.impact_snapshot_id IS NULL THEN 'UNVERIFIED' WHEN "
    "c.impact_trust_issue_count > 0 THEN 'WARNING' ELSE 'TRUSTED' END AS impact_confidence_status, "
    "coalesce(c.impact_trust_issue_count, 0) AS impact_trust_issue_count FROM c_status s JOIN c_assets a ON a.asset_id = "
    "s.asset_id JOIN c_zones z ON z.zone_id = s.zone_id LEFT JOIN c_queue q ON q.incident_id = s.incident_id LEFT JOIN "
    "c_latest_desc m ON m.incident_id = s.incident_id LEFT JOIN c_impact_counts c ON c.incident_id = s.incident_id",
    "incident_timeline": "SELECT incident_id, event_id, stage, event_type, event_status, occurred_at, actor_type, "
    "reason_code, json_extract_string(metadata_json, '$.message') AS message FROM c_events",
    "work_orders_with_spares": "SELECT w.* EXCLUDE (h), s.spare_name AS required_spare_name, s.stock_status FROM "
    "c_work_orders w LEFT JOIN c_spares s ON s.spare_id = w.required_spare_id",
    "validation_status_summary": "SELECT i.incident_id, coalesce(v.t, 'No validation records') AS validation_summary FROM "
    "c_incidents i LEFT JOIN (SELECT incident_id, string_agg(n || ' ' || upper(validation_status[1]) || "
    "lower(validation_status[2:]), ' / ' ORDER BY validation_status) AS t FROM (SELECT incident_id, "
    "validation_status, count(*) AS n FROM c_validations GROUP BY 1, 2) t GROUP BY incident_id) v USING (incident_id)",
    "overview": "SELECT i.*, s.*, b.*, w.*, r.*, m.*, l.*, q.* FROM (SELECT count(*) AS total_requests, count(*) FILTER "
    "(current_status <> 'RESTORED') AS open_requests, round(avg(coalesce(nullif(actual_downtime_hours, 0), "
    "estimated_downtime_hours)), 2) AS avg_downtime_hours FROM c_incidents) i, (SELECT count(*) AS delayed_requests, "
    "count(*) FILTER (criticality_level = 'CRITICAL') AS critical_asset_delayed FROM c_status JOIN c_assets USING "
    "(asset_id) WHERE is_delayed) s, (SELECT first(stage ORDER BY total_delay_hours DESC, stage) AS top_bottleneck_stage, "
    "round(sum(total_delay_hours) FILTER (stage = 'ENGINEER_ASSIGNED'), 2) AS engineer_assignment_delay_hours FROM "
    "c_bottlenecks WHERE dimension_type = 'STAGE') b, (SELECT round(sum(total_wait_hours), 2) AS spare_waiting_delay_hours "
    "FROM c_spare_waits) w, (SELECT count(*) FILTER (repeat_failure_count > 0) AS repeat_failure_asset_count FROM "
    "c_asset_delays) r, (SELECT round(sum(estimated_capacity_risk_kw), 2) AS capacity_risk_kw, CAST(sum(affected_gpu_count) "
    "AS BIGINT) AS affected_gpu_count, count(*) FILTER (power_redundancy_lost OR cooling_redundancy_lost OR "
    "redundancy_state = 'N-1') AS redundancy_lost_incidents, count(*) FILTER (vendor_status = 'ETA_MISSED') AS "
    "vendor_eta_missed_count FROM c_latest_asc WHERE incident_id IN (SELECT incident_id FROM c_incidents WHERE "
    "current_status <> 'RESTORED')) m, (SELECT status AS latest_pipeline_run_status FROM c_ledger ORDER BY started_at DESC, "
    "pipeline_run_id LIMIT 1) l, (SELECT CASE WHEN count(*) FILTER (status <> 'PASS') > 0 THEN 'FAILED' ELSE 'PASS' END AS "
    "data_quality_status FROM c_checks) q",
    "impact_summary": "SELECT count(impact_snapshot_id) AS incident_count, round(sum(estimated_capacity_risk_kw), 2) AS "
    "capacity_risk_kw, CAST(sum(affected_rack_count) AS BIGINT) AS affected_rack_count, CAST(sum(affected_gpu_count) AS "
    "BIGINT) AS affected_gpu_count, count(*) FILTER (power_redundancy_lost OR cooling_redundancy_lost OR redundancy_state = "
    "'N-1') AS redundancy_lost_incidents, count(*) FILTER (vendor_status = 'ETA_MISSED') AS vendor_eta_missed_count, "
    "count(*) FILTER (mitigation_status <> 'NONE') AS mitigated_incidents, CAST(sum(thermal_breach_minutes) AS BIGINT) AS "
    "thermal_breach_minutes, count(*) FILTER (impact_snapshot_id IS NOT NULL AND n IS NULL) AS trusted_impact_count, "
    "count(*) FILTER (impact_snapshot_id IS NOT NULL AND n IS NOT NULL) AS warning_impact_count, count(*) FILTER "
    "(impact_snapshot_id IS NULL AND (n IS NOT NULL OR high)) AS unverified_impact_count FROM (SELECT i.incident_id, "
    f"priority_level IN ('CRITICAL', 'HIGH') OR regexp_matches(upper(business_impact), '{vocab.HIGH_IMPACT_PATTERN}') AS "
    "high, m.*, c.impact_trust_issue_count AS n FROM c_incidents i LEFT JOIN c_latest_asc m ON m.incident_id = "
    "i.incident_id LEFT JOIN c_impact_counts c ON c.incident_id = i.incident_id WHERE i.current_status <> 'RESTORED') t",
    "latest_runs": "SELECT * FROM c_ledger ORDER BY started_at DESC, pipeline_run_id LIMIT 10",
    "filter_metadata": "SELECT 'infrastructure_zones' AS list, zone_id AS value, zone_name AS name FROM c_zones UNION ALL "
    "SELECT 'assets', asset_id, asset_name FROM c_assets UNION ALL " + union(*[
        f"(SELECT DISTINCT '{name}' AS list, {column} AS value, CAST(NULL AS VARCHAR) AS name FROM {source})"
        for name, column, source in [
            ("asset_types", "asset_type", "c_assets"), ("facilities_teams", "assigned_team", "c_work_orders"),
            ("spare_categories", "spare_category", "c_spares"), ("priority_levels", "priority_level", "c_incidents"),
            ("request_types", "request_type", "c_incidents"), ("failure_modes", "failure_mode", "c_incidents"),
            ("stages", "current_stage", "c_queue")]]),
    "topology": "SELECT * FROM c_edges_named",
    "topology_power_paths": "SELECT * FROM c_edges_named WHERE dependency_type = 'POWER_PATH' ORDER BY dependency_type, "
    "dependent_asset_id, dependency_asset_id LIMIT 100",
    "impact_tones": "SELECT impact_snapshot_id, CASE WHEN estimated_capacity_risk_kw <= 0 THEN NULL WHEN "
    "estimated_capacity_risk_kw >= 500 OR estimated_gpu_capacity_risk_pct >= 25 THEN 'danger' ELSE 'warning' END AS "
    "capacity_tone, CASE redundancy_state WHEN 'N-1' THEN 'danger' WHEN 'N' THEN 'warning' END AS redundancy_tone, "
    "CASE vendor_status WHEN 'ETA_MISSED' THEN 'danger' WHEN 'WAITING_VENDOR_DISPATCH' THEN 'warning' END AS vendor_tone, "
    "CASE WHEN mitigation_status IN ('RUNNING_DEGRADED', 'LOAD_SHIFTED') THEN 'warning' END AS mitigation_tone FROM "
    "c_snapshots",
    "reading_tones": "SELECT impact_snapshot_id, 'inlet_temp' AS metric, CAST(31 AS DOUBLE) AS value, 'C' AS unit, "
    "reading_status AS status, CASE upper(reading_status) WHEN 'CRITICAL' THEN 'danger' WHEN 'WARNING' THEN 'warning' "
    "WHEN 'AT_RISK' THEN 'warning' END AS telemetry_tone FROM c_snapshots UNION ALL SELECT impact_snapshot_id, 'load', "
    "CAST(0.5 AS DOUBLE), 'ratio', 'NORMAL', NULL FROM c_snapshots",
    "raw_check_failures": "SELECT * FROM c_raw_failures",
    "core_check_failures": "SELECT * FROM c_core_failures",
    "quality_checks": "SELECT * FROM c_checks",
    "failed_quality_checks": "SELECT check_result_id, check_name, target_table, failed_row_count FROM c_checks WHERE status "
    "= 'FAILED'",
    "one_quality_check": "SELECT * FROM c_checks WHERE check_result_id = 'DQ-RUN-1-030'",
    **{f"check_{name.removeprefix('c_v_')}": f"SELECT {ISSUE_COLUMNS} FROM {name}" for name in list(CTES)
       if name.startswith("c_v_")},
    "check_all_issues": "SELECT * FROM c_all_issues",
    "issue_evidence": "SELECT * FROM c_issue_evidence",
    "quality_flags": "SELECT * FROM c_quality_flags",
    "incident_detail": "SELECT i.incident_id, " + ", ".join(
        f"coalesce(list(item ORDER BY a, b, item) FILTER (section = {k}), []) AS {name}" for k, name in enumerate(_sections)
    ) + " FROM c_incidents i LEFT JOIN c_detail d ON d.incident_id = i.incident_id GROUP BY 1",
    "incident_detail_long": "SELECT incident_id, " + lookup("section::VARCHAR", {str(k): n for k, n in enumerate(_sections)})
    + " AS section, a AS first, b AS second, item FROM c_detail WHERE incident_id IN (SELECT incident_id FROM c_incidents) "
    "AND incident_id IN (SELECT incident_id FROM c_detail GROUP BY 1 HAVING count(*) > 40)",
    "impact_trust_flags": "SELECT incident_id, issue_type, severity, message, evidence_json FROM c_v_impact_issues",
    "downstream_assets": "SELECT * FROM c_reach",
    "blast_radius_incidents": "SELECT o.origin, i.incident_id, i.asset_id, i.request_title AS title, i.current_stage AS "
    "stage FROM (SELECT dependency_asset_id AS origin FROM c_dependencies WHERE dependency_asset_id <> dependent_asset_id "
    "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) o JOIN c_incidents i ON i.asset_id = o.origin OR i.asset_id IN (SELECT "
    "asset FROM c_reach r WHERE r.origin = o.origin)",
    "blast_radius_counts": "SELECT origin, count(*) - 1 AS downstream_assets, CAST(coalesce(sum(n), 0) AS BIGINT) AS "
    "affected_incidents FROM (SELECT * FROM c_reach UNION ALL SELECT DISTINCT origin, origin FROM c_reach) r LEFT JOIN "
    "(SELECT asset_id, count(*) AS n FROM c_incidents GROUP BY 1) i ON i.asset_id = r.asset GROUP BY 1",
    "direct_dependencies": "SELECT dependent_asset_id AS asset_id, dependency_id, dependent_asset_id, dependency_asset_id, "
    "dependency_type, dependency_role FROM c_dependencies UNION ALL SELECT dependency_asset_id, dependency_id, "
    "dependent_asset_id, dependency_asset_id, dependency_type, dependency_role FROM c_dependencies WHERE "
    "dependency_asset_id <> dependent_asset_id",
    "named_paths": "SELECT path_id, label, list_concat([first(dependent_asset_id ORDER BY step)], list(dependency_asset_id "
    "ORDER BY step)) AS nodes, CAST(first(dependent_active_incident_count ORDER BY step) + "
    "sum(dependency_active_incident_count) AS BIGINT) AS active_incident_count FROM (SELECT 'PATH-ASSET-' || s_suppkey AS "
    "path_id, s_name AS label, step, 'DEP-' || CAST(floor(s_suppkey / pow(2, step)) AS BIGINT) AS dependency_id FROM "
    "supplier, LATERAL (SELECT unnest(range(CAST(floor(log2(greatest(s_suppkey, 1))) AS BIGINT) + 1)) AS step) x) p JOIN "
    "c_edges_named USING (dependency_id) GROUP BY 1, 2",
    "enumerated_paths": _enumerated("SELECT * FROM c_edges_up", 32),
    "enumerated_paths_short": _enumerated("SELECT * FROM c_edges_ring", 5),
    "incident_evidence": "SELECT i.incident_id, request_title, i.asset_id, current_stage AS workflow_stage, current_status, "
    "priority_level, issue_id AS trust_issue_id FROM c_incidents i LEFT JOIN c_numbered_impact USING (incident_id)",
    "core_triples": "SELECT * FROM c_core_triples UNION ALL SELECT * FROM c_trust_triples",
    "triple_export": f"SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' WHEN "
    f"o_datatype = '{XSD}string' THEN '\"' || o || '\"' ELSE '\"' || o || '\"^^<' || o_datatype || '>' END || ' .' AS line "
    "FROM c_core_triples",
    "runtime_shape_report": report("c_broken", "c_runtime_types", shp.RUNTIME_SHAPES),
    "runtime_conformance": "SELECT count(*) = 0 AS conforms, count(*) AS issue_count FROM ("
    + report("c_core_triples", "c_full_types", shp.RUNTIME_SHAPES) + ") t",
    "canonical_triples": f"SELECT '{fnd.CANONICAL}' AS graph, * FROM c_canon",
    "entailed_types": "SELECT * FROM c_types",
    "contract_shape_report": "SELECT * FROM c_contract_report",
    "dependency_exposure": "SELECT * FROM c_f_exposure",
    "blast_radius": "SELECT * FROM c_f_blast",
    "recovery_blocker": "SELECT * FROM c_f_blocker",
    "restore_readiness": "SELECT * FROM c_f_readiness",
    "impact_trust": "SELECT * FROM c_f_trust",
    "finding_lineage": f"SELECT DISTINCT finding, '{ONT}' || finding_type AS finding_type, derived_from AS source_fact, CASE "
    f"WHEN finding_type <> 'TrustFinding' THEN '{_activity}' END AS activity FROM c_findings",
    "provenance_edges": "SELECT * FROM c_provenance",
    "provenance_edges_of_activity": f"SELECT * FROM c_provenance WHERE s = '{_activity}' OR o = '{_activity}'",
    "promoted_triples": "SELECT s, p, o, o_kind, o_datatype, CASE WHEN s IN (SELECT focus_node FROM c_contract_report) THEN "
    "'quarantined' ELSE 'promoted' END AS outcome FROM c_canon",
    "promotion_gates": "SELECT *, canonical_conforms AND shape_valid AND has_provenance AND not_stale AND not_conflicting AND "
    "human_approved AS approved FROM (SELECT finding, finding_type, (SELECT count(*) = 0 FROM c_contract_report) AS "
    "canonical_conforms, count(*) FILTER (text = '') = 0 AS shape_valid, count(derived_from) > 0 AS has_provenance, "
    "count(*) FILTER (derived_from IS NOT NULL AND derived_from NOT IN (SELECT s FROM c_canon WHERE p = "
    f"'{ONT}hasIdentifier' AND s[-1] <> '8')) = 0 AS not_stale, min(text) = max(text) AS not_conflicting, finding_type = 'RecoveryBlocker' OR "
    "finding[-1] = '5' AS human_approved FROM c_findings GROUP BY 1, 2) t",
}


def ties_to_even(sql: str) -> str:
    """Writes every round(x, n) as a rounding to even of x * 10^n."""
    at = 0
    while match := re.compile(r"\bround\(").search(sql, at):
        depth, comma, end = 1, None, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        at = match.end()
        if comma is not None:
            value, scale = sql[match.end() : comma], f"1e{sql[comma + 1 : end - 1].strip()}"
            sql = f"{sql[: match.start()]}(round_even(({value}) * {scale}, 0) / {scale}){sql[end:]}"
    return sql


def oracle_sql() -> dict[str, str]:
    return {name: ties_to_even(build(sql)) for name, sql in FINAL.items()}
