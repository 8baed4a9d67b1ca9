"""The ranked follow-up queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import scoring
from faultline.functions.scalar import is_active, round_even
from faultline.operators.skew import global_rank, spread_nulls
from faultline.operators.workflow import latest_snapshots, lead_profile


def spare_risk(work_orders: DataFrame, spares: DataFrame) -> DataFrame:
    """Spare risk of each incident: waiting 14, out of stock 18 or low stock 10, each critical spare adds 4, at most 22.

    Read in work-order id order the rule is: keep the highest level so far, then add 4 for a critical spare. The result
    equals the best, over the levels, of ``level + 4 * (critical spares from the first order at that level on)``, so two
    map-side combined aggregations replace an ordered pass over the incident's orders, however many there are.
    """
    stock = F.col("stock_status")
    level = F.greatest(
        F.when(F.col("work_order_status") == "WAITING_SPARE_VENDOR", 14).otherwise(0),
        F.when(stock == "OUT_OF_STOCK", 18).when(stock == "LOW_STOCK", 10).otherwise(0),
    )
    orders = work_orders.join(
        spares.select("spare_id", "stock_status", "critical_spare"),
        spread_nulls(F.col("required_spare_id"), "work_order_id") == F.col("spare_id"),
        "left",
    ).select(
        "incident_id",
        "work_order_id",
        level.alias("level"),
        F.coalesce("critical_spare", F.lit(False)).alias("critical"),
        F.coalesce(stock == "OUT_OF_STOCK", F.lit(False)).alias("out_of_stock"),
    )
    levels = [10, 14, 18]
    first = orders.where("level > 0").groupBy("incident_id").agg(
        *[F.min(F.when(F.col("level") >= x, F.col("work_order_id"))).alias(f"from_{x}") for x in levels]
    )
    counts = (
        orders.where("level > 0 OR critical")
        .join(first, "incident_id", "left")
        .groupBy("incident_id")
        .agg(
            F.count_if("critical").alias("critical_all"),
            F.max("out_of_stock").alias("needs_out_of_stock_spare"),
            *[F.max(f"from_{x}").isNotNull().alias(f"has_{x}") for x in levels],
            *[
                F.count_if(F.col("critical") & (F.col("work_order_id") >= F.col(f"from_{x}"))).alias(f"critical_{x}")
                for x in levels
            ],
        )
    )
    reached = [F.when(F.col(f"has_{x}"), x + 4 * F.col(f"critical_{x}")) for x in levels]
    return counts.select(
        "incident_id",
        F.least(F.greatest(4 * F.col("critical_all"), *reached), F.lit(22)).cast("double").alias("spare_risk"),
        "needs_out_of_stock_spare",
    )


def scored_incidents(
    incidents: DataFrame,
    assets: DataFrame,
    zones: DataFrame,
    leads: DataFrame,
    status: DataFrame,
    work_orders: DataFrame,
    spares: DataFrame,
    snapshots: DataFrame,
    as_of: Column,
) -> DataFrame:
    """Active incidents with their unrounded score components and texts."""
    per_asset = incidents.groupBy("asset_id").agg(F.count(F.lit(1)).alias("asset_incident_count"))
    latest = latest_snapshots(snapshots, "asc").drop("asset_id", "zone_id", "source_system", "metadata_json")
    joined = (
        incidents.where(is_active())
        .select("incident_id", "asset_id", "zone_id", "current_stage", "needed_by_at", "estimated_downtime_hours")
        .join(status.select("incident_id", "is_delayed", "hours_in_current_stage"), "incident_id")
        .join(lead_profile(leads).select("incident_id", "open_delay_hours"), "incident_id", "left")
        .join(spare_risk(work_orders, spares), "incident_id", "left")
        .join(latest, "incident_id", "left")
        .join(assets.select("asset_id", "criticality_level"), "asset_id")
        .join(zones.select("zone_id", "zone_name", "zone_priority"), "zone_id")
        .join(per_asset, "asset_id", "left")
    )
    scored = joined.withColumns(scoring.components(as_of))
    return scored.withColumns(
        {
            "total": scoring.total_score(),
            "recommended_action": scoring.recommended_action(),
            "reason_summary": scoring.reason_summary(),
        }
    )


def shown(scored: DataFrame, *more: str) -> DataFrame:
    """The columns of the queue, rounded; without a rank unless it is among `more`."""
    return scored.select(
        "incident_id",
        *more,
        "asset_id",
        "zone_id",
        "current_stage",
        *[round_even(name, 2).alias(name) for name in scoring.COMPONENTS],
        round_even("total", 2).alias("total_priority_score"),
        "recommended_action",
        "reason_summary",
    )


def follow_up_queue(scored: DataFrame) -> DataFrame:
    """Rank by unrounded total, then incident id; round only what is shown."""
    slim = scored.select(
        "incident_id",
        "asset_id",
        "zone_id",
        "current_stage",
        *scoring.COMPONENTS,
        "total",
        "recommended_action",
        "reason_summary",
    )
    return shown(global_rank(slim, [F.desc("total"), F.asc("incident_id")], "priority_rank"), "priority_rank")
