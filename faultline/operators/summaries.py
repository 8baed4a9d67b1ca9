"""Delay and bottleneck summaries. Fan-out over work orders is done with weights, never by emitting pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import vocab
from faultline.functions.scalar import MICROS_PER_HOUR, actual_or_estimated, explode_present, lookup, round_even, truthy
from faultline.operators.skew import HOT_ROWS, nearest_rank
from faultline.operators.workflow import lead_profile

GROUP = ["dimension_type", "dimension_id", "stage"]


def _dimension_frequencies(
    leads: DataFrame,
    incidents: DataFrame,
    assets: DataFrame,
    zones: DataFrame,
    work_orders: DataFrame,
    spares: DataFrame,
) -> DataFrame:
    """(dimension, stage, duration) -> number of records. A record counts once per matching work order."""
    records = (
        leads.where(F.col("stage") != vocab.RESTORED)
        .groupBy("incident_id", "stage", "duration_us")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    described = (
        records.join(
            incidents.select(
                "incident_id", "asset_id", "zone_id", "priority_level", "request_type", "failure_mode"
            ),
            "incident_id",
        )
        .join(assets.select("asset_id", "asset_type", "criticality_level", F.lit(True).alias("_asset")),
              "asset_id", "left")
        .join(zones.select("zone_id", F.lit(True).alias("_zone")), "zone_id", "left")
    )

    def dimension(name: str, value: str, known: str | None = None) -> Column:
        struct = F.struct(F.lit(name).alias("dimension_type"), F.col(value).alias("dimension_id"))
        return F.when(F.col(known), struct) if known else struct

    own = [
        dimension("STAGE", "stage"),
        dimension("PRIORITY_LEVEL", "priority_level"),
        dimension("REQUEST_TYPE", "request_type"),
        dimension("FAILURE_MODE", "failure_mode"),
        dimension("ASSET", "asset_id", "_asset"),
        dimension("ASSET_TYPE", "asset_type", "_asset"),
        dimension("ASSET_CRITICALITY", "criticality_level", "_asset"),
        dimension("INFRASTRUCTURE_ZONE", "zone_id", "_zone"),
    ]
    direct = explode_present(described, own, "d", "stage", "duration_us", "n").select(
        "d.*", "stage", "duration_us", "n"
    )
    ordered = work_orders.join(
        spares.select(F.col("spare_id").alias("required_spare_id"), "spare_category"), "required_spare_id", "left"
    )
    by_order = [
        dimension("FACILITIES_TEAM", "assigned_team"),
        F.when(
            F.col("spare_category").isNotNull(),
            F.struct(F.lit("SPARE_CATEGORY").alias("dimension_type"), F.col("spare_category").alias("dimension_id")),
        ),
    ]
    weights = (
        explode_present(ordered, by_order, "d", "incident_id")
        .groupBy("incident_id", "d.dimension_type", "d.dimension_id")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    known = records.join(incidents.select("incident_id"), "incident_id", "left_semi")
    through_orders = known.join(weights, "incident_id").select(
        "dimension_type", "dimension_id", "stage", "duration_us", (F.col("n") * F.col("w")).alias("n")
    )
    return direct.unionByName(through_orders).groupBy(*GROUP, "duration_us").agg(F.sum("n").alias("n"))


def bottleneck_summary(
    leads: DataFrame,
    incidents: DataFrame,
    assets: DataFrame,
    zones: DataFrame,
    work_orders: DataFrame,
    spares: DataFrame,
    as_of: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Counts, delay rate, average, nearest-rank p90 and total delay by ten dimensions and stage."""
    freq = _dimension_frequencies(leads, incidents, assets, zones, work_orders, spares)
    hours = F.col("duration_us") / F.lit(float(MICROS_PER_HOUR))
    threshold = lookup("stage", {k: float(v) for k, v in vocab.THRESHOLD_HOURS.items()}, 0.0)
    delay = F.greatest(hours - threshold, F.lit(0.0))
    totals = [
        F.sum("n").alias("request_count"),
        F.sum(F.when(delay > 0, F.col("n")).otherwise(F.lit(0))).alias("delayed_count"),
        F.sum(hours * F.col("n")).alias("_hours"),
        F.sum(delay * F.col("n")).alias("_delay"),
    ]
    if _distinct_durations(leads, hot_rows) <= hot_rows:
        group = Window.partitionBy(*GROUP)
        upto = F.sum("n").over(group.orderBy("duration_us").rowsBetween(Window.unboundedPreceding, 0))
        rank = F.rint((F.sum("n").over(group) - 1) * F.lit(0.9))
        placed = freq.withColumn("_upto", upto).withColumn("_rank", rank)
        at_or_above = F.when(F.col("_upto") > F.col("_rank"), F.col("duration_us"))
        summary = placed.groupBy(*GROUP).agg(*totals, F.min(at_or_above).alias("picked"))
    else:
        p90 = nearest_rank(freq, GROUP, "duration_us", "n", 0.9)
        summary = freq.groupBy(*GROUP).agg(*totals).join(p90, GROUP)
    return summary.select(
        as_of.cast("date").alias("summary_date"),
        *GROUP,
        "request_count",
        "delayed_count",
        round_even(F.col("delayed_count") / F.col("request_count"), 4).alias("delay_rate"),
        round_even(F.col("_hours") / F.col("request_count"), 2).alias("avg_duration_hours"),
        round_even(F.col("picked") / F.lit(float(MICROS_PER_HOUR)), 2).alias("p90_duration_hours"),
        round_even("_delay", 2).alias("total_delay_hours"),
    )


def _distinct_durations(leads: DataFrame, enough: int) -> int:
    """Upper bound on the distinct durations in any group: no group has more than its whole stage."""
    rows = leads.count()  # the windows are pruned from this plan, so it only counts entries
    if rows <= enough:
        return rows
    per_stage = leads.groupBy("stage").agg(F.approx_count_distinct("duration_us", 0.01).alias("v"))
    return int(1.05 * (per_stage.agg(F.max("v")).first()[0] or 0))


def most_common(df: DataFrame, group: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """Per group: the most frequent value (ties alphabetical) and sums, via one pre-aggregation per (group, value)."""
    parts = df.groupBy(*group, value).agg(
        F.count(value).alias("_votes"), *[expr.alias(name) for name, expr in sums.items()]
    )
    voted = F.when(F.col("_votes") > 0, F.struct(-F.col("_votes"), F.col(value)))
    return parts.groupBy(*group).agg(
        F.min_by(value, voted).alias("top_value"), *[F.sum(name).alias(name) for name in sums]
    )


def _incident_facts(incidents: DataFrame, profile: DataFrame, status: DataFrame) -> DataFrame:
    """Incidents with at least one lead-time record, with their delay figures."""
    late = status.where("is_delayed").select("incident_id", F.lit(1).alias("_late"))
    return (
        incidents.join(profile, "incident_id")
        .join(late, "incident_id", "left")
        .withColumn("_late", F.coalesce("_late", F.lit(0)))
        .withColumn("_downtime", actual_or_estimated())
    )


def asset_delay_summary(
    incidents: DataFrame, assets: DataFrame, zones: DataFrame, leads: DataFrame, status: DataFrame
) -> DataFrame:
    sums = {
        "request_count": F.count(F.lit(1)),
        "delayed_request_count": F.sum("_late"),
        "_down": F.sum("_downtime"),
        "_delay": F.sum("total_delay_hours"),
        "_repair": F.sum("repair_hours"),
        "_repairs": F.count("repair_hours"),
    }
    facts = _incident_facts(incidents, lead_profile(leads), status)
    grouped = most_common(facts, ["asset_id"], "failure_mode", sums)
    n = F.col("request_count")
    return (
        grouped.join(assets.select("asset_id", "asset_name", "zone_id"), "asset_id")
        .join(zones.select("zone_id", "zone_name"), "zone_id")
        .select(
            "asset_id",
            "asset_name",
            "zone_id",
            "zone_name",
            n,
            "delayed_request_count",
            F.when(n > 1, n).otherwise(F.lit(0)).alias("repeat_failure_count"),
            round_even(F.col("_down") + F.col("_delay"), 2).alias("total_downtime_hours"),
            round_even(F.coalesce(F.try_divide("_repair", "_repairs"), F.lit(0.0)), 2).alias(
                "avg_repair_duration_hours"
            ),
            F.col("top_value").alias("top_failure_mode"),
        )
    )


def zone_delay_summary(
    incidents: DataFrame, assets: DataFrame, zones: DataFrame, leads: DataFrame, status: DataFrame
) -> DataFrame:
    """Keyed by the zone on the incident, which need not be the zone of its asset."""
    critical = assets.where(F.col("criticality_level") == "CRITICAL").select("asset_id", F.lit(1).alias("_critical"))
    facts = _incident_facts(incidents, lead_profile(leads), status).join(critical, "asset_id", "left")
    sums = {
        "open_request_count": F.count_if(F.col("current_status") != vocab.RESTORED),
        "delayed_request_count": F.sum("_late"),
        "critical_asset_delayed_count": F.sum(F.col("_late") * F.coalesce("_critical", F.lit(0))),
        "_down": F.sum("_downtime"),
        "_delay": F.sum("total_delay_hours"),
    }
    grouped = most_common(facts, ["zone_id"], "top_stage", sums)
    return grouped.join(zones.select("zone_id", "zone_name"), "zone_id").select(
        "zone_id",
        "zone_name",
        "open_request_count",
        "delayed_request_count",
        "critical_asset_delayed_count",
        round_even(F.col("_down") + F.col("_delay"), 2).alias("total_downtime_hours"),
        F.coalesce("top_value", F.lit("NONE")).alias("top_bottleneck_stage"),
    )


def spare_waiting_summary(
    leads: DataFrame, incidents: DataFrame, work_orders: DataFrame, spares: DataFrame
) -> DataFrame:
    """Waiting time per spare. A record counts once per work order that needs the spare."""
    waits = (
        leads.where((F.col("stage") == "SPARE_VENDOR_WAITING") & (F.col("delay_hours") > 0))
        .groupBy("incident_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("duration_hours").alias("hours"))
        .join(incidents.select("incident_id"), "incident_id", "left_semi")
    )
    needs = (
        work_orders.where(truthy("required_spare_id"))
        .groupBy("incident_id", F.col("required_spare_id").alias("spare_id"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    per_spare = (
        waits.join(needs, "incident_id")
        .groupBy("spare_id")
        .agg(
            F.count(F.lit(1)).alias("waiting_request_count"),
            F.sum(F.col("hours") * F.col("w")).alias("_hours"),
            F.sum(F.col("n") * F.col("w")).alias("_records"),
        )
    )
    return per_spare.join(spares, "spare_id").select(
        "spare_id",
        "spare_name",
        "spare_category",
        "waiting_request_count",
        round_even("_hours", 2).alias("total_wait_hours"),
        round_even(F.col("_hours") / F.col("_records"), 2).alias("avg_wait_hours"),
        "critical_spare",
        "stock_status",
    )
