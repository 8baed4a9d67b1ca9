"""State reconstruction from the event history: stage lead times, latest records and current status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import vocab
from faultline.functions.scalar import lookup, micros_between, plus_hours, round_even, truthy
from faultline.functions.scalar import MICROS_PER_HOUR
from faultline.operators.skew import HOT_ROWS, Chunked, chunk_hot_keys



def event_order() -> Column:
    return F.struct("occurred_at", "event_id")


def default_as_of(events: DataFrame) -> Column:
    """Last workflow event plus a day, or last event of any kind plus a day, as a one-row scalar subquery."""
    workflow_types = [vocab.ENTERED, vocab.INCIDENT_RESTORED, *vocab.EXIT_EVENT.values()]
    in_workflow = F.when(F.col("event_type").isin(workflow_types), F.col("occurred_at"))
    last = F.coalesce(F.max(in_workflow), F.max("occurred_at"))
    return events.agg(plus_hours(last, 24).alias("as_of")).scalar()


def as_of_column(events: DataFrame, as_of: datetime | None) -> Column:
    return default_as_of(events) if as_of is None else F.lit(as_of).cast("timestamp_ntz")


def is_stage_exit() -> Column:
    return F.coalesce(
        (F.col("event_type") == vocab.INCIDENT_RESTORED)
        | (F.col("event_type") == lookup("stage", vocab.EXIT_EVENT)),
        F.lit(False),
    )


def lead_times(events: DataFrame, as_of: datetime | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per ENTERED_STAGE event with its exit, duration, threshold and delay.

    The exit is the first exit event after the entry with no other stage in between. Events are read newest first, so
    the nearest exit is a running ``last`` and one sort serves every step: an exit counts when no change of stage lies
    between it and the entry.
    """
    slim = events.select("incident_id", "event_id", "stage", "event_type", "occurred_at")
    chunked = chunk_hot_keys(slim, ["incident_id"], ["occurred_at", "event_id"], hot_rows)
    newest_first = Window.partitionBy(*chunked.partition_keys).orderBy(F.desc("occurred_at"), F.desc("event_id"))
    later = F.lag("stage").over(newest_first)
    changed = F.when(~later.eqNullSafe(F.col("stage")) & later.isNotNull(), 1).otherwise(0)
    runs = chunked.df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(newest_first))
    nearest = F.last(F.when(is_stage_exit(), F.struct("run", "occurred_at")), ignorenulls=True).over(
        newest_first.rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.withColumn("_exit", nearest)
    entries = runs.where(F.col("event_type") == vocab.ENTERED).withColumn(
        "exited_at", F.when(F.col("_exit.run") == F.col("run"), F.col("_exit.occurred_at"))
    )
    if chunked.split:
        entries = _carry_exits(chunked, runs, entries)
    end = F.coalesce(F.col("exited_at"), as_of_column(events, as_of))
    micros = F.greatest(micros_between("occurred_at", end), F.lit(0))
    threshold = lookup("stage", {k: float(v) for k, v in vocab.THRESHOLD_HOURS.items()}, 0.0)
    hours = F.col("duration_us") / F.lit(float(MICROS_PER_HOUR))
    return (
        entries.withColumn("duration_us", micros)
        .select(
            "incident_id",
            "event_id",
            "stage",
            F.col("occurred_at").alias("entered_at"),
            "exited_at",
            "duration_us",
            hours.alias("duration_hours"),
            threshold.alias("threshold_hours"),
            F.greatest(hours - threshold, F.lit(0.0)).alias("delay_hours"),
        )
        .withColumn("is_bottleneck", F.col("delay_hours") > 0)
    )


def _carry_exits(chunked: Chunked, runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Resolve entries whose run reaches past their chunk: look into the following chunks of the same incident.

    Per chunk only its first stage, last stage, and the first exit of its opening run matter. A chunk that is one run of
    the stage carried in and has no exit passes the question on; any other chunk answers it.
    """
    keys = chunked.partition_keys
    per_run = runs.groupBy(*keys, "run").agg(
        F.min(F.when(is_stage_exit(), F.col("occurred_at"))).alias("first_exit"), F.first("stage").alias("stage")
    )
    per_chunk = per_run.groupBy(*keys).agg(
        F.max_by("stage", "run").alias("first_stage"),
        F.min_by("stage", "run").alias("last_stage"),
        F.max_by("first_exit", "run").alias("opening_exit"),
        F.count(F.lit(1)).alias("run_count"),
    )
    # One row per chunk: a third of a trillion events at a million rows a chunk is still a small window.
    ascending = Window.partitionBy(*chunked.keys).orderBy("chunk")
    continues = F.col("first_stage").eqNullSafe(F.lag("last_stage").over(ascending))
    per_chunk = per_chunk.withColumn("_continues", continues)
    answers = ~(F.col("_continues") & (F.col("run_count") == 1) & F.col("opening_exit").isNull())
    answer = F.when(answers, F.struct(F.when(F.col("_continues"), F.col("opening_exit")).alias("at")))
    after = Window.partitionBy(*chunked.keys).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.withColumn("_answer", answer).select(
        *keys, F.last("_answer", ignorenulls=True).over(after).getField("at").alias("_carried")
    )
    open_at_end = (F.col("run") == 0) & F.col("exited_at").isNull()
    return entries.join(carried, keys, "left").withColumn(
        "exited_at", F.when(open_at_end, F.col("_carried")).otherwise(F.col("exited_at"))
    )


def lead_time_table(leads: DataFrame) -> DataFrame:
    """The stored form of lead times: rounded hours, no helper columns."""
    return leads.select(
        "incident_id",
        "stage",
        "entered_at",
        "exited_at",
        round_even("duration_hours", 2).alias("duration_hours"),
        round_even("threshold_hours", 2).alias("threshold_hours"),
        "is_bottleneck",
        round_even("delay_hours", 2).alias("delay_hours"),
    )


def lead_profile(leads: DataFrame) -> DataFrame:
    """Everything later steps ask of an incident's lead times, in one map-side combined aggregation."""
    order = F.struct("entered_at", "event_id")
    delayed = F.col("delay_hours") > 0
    return leads.groupBy("incident_id").agg(
        F.sum("delay_hours").alias("total_delay_hours"),
        F.max_by(
            F.col("delay_hours"), F.when(F.col("exited_at").isNull(), order)
        ).alias("open_delay_hours"),
        F.max_by(
            F.col("duration_hours"), F.when(F.col("stage") == "REPAIR_IN_PROGRESS", order)
        ).alias("repair_hours"),
        F.min_by(
            F.col("stage"), F.when(delayed, F.struct(-F.col("delay_hours"), F.col("entered_at"), F.col("event_id")))
        ).alias("top_stage"),
    )


def latest_snapshots(snapshots: DataFrame, tie: str = "asc") -> DataFrame:
    """The latest impact snapshot of each incident; equal times are broken by the smallest or largest id."""
    row = F.struct(*snapshots.columns)
    if tie == "asc":
        newest = F.struct(-F.unix_micros(F.col("snapshot_at").cast("timestamp")), F.col("impact_snapshot_id"))
        picked = F.min_by(row, newest)
    else:
        picked = F.max_by(row, F.struct("snapshot_at", "impact_snapshot_id"))
    return snapshots.groupBy("incident_id").agg(picked.alias("_row")).select("_row.*")


def event_profile(events: DataFrame) -> DataFrame:
    """Per incident: the latest events of each kind the reconciliation rules look at, combined map-side."""
    kind = F.col("event_type")
    brief = F.struct("occurred_at", "event_id", "event_type")

    def latest(types: list[str]) -> Column:
        return F.max(F.when(kind.isin(types), brief))

    def first(event_type: str) -> Column:
        return F.min(F.when(kind == event_type, F.col("occurred_at")))

    return events.groupBy("incident_id").agg(
        F.max(F.when(kind == vocab.ENTERED, F.struct("occurred_at", "event_id", "stage"))).alias("latest_entered"),
        F.count_if(kind == vocab.INCIDENT_RESTORED).alias("restore_count"),
        latest(vocab.IMPACT_EVENTS).alias("latest_impact"),
        latest(["REDUNDANCY_LOST", "REDUNDANCY_RESTORED"]).alias("latest_redundancy"),
        latest(["VENDOR_ETA_UPDATED", "VENDOR_ETA_MISSED"]).alias("latest_vendor"),
        first("LOAD_SHIFTED").alias("first_load_shift"),
        first("MITIGATION_APPLIED").alias("first_mitigation"),
    )


def work_order_owners(work_orders: DataFrame) -> DataFrame:
    """First team and first engineer of each incident's work orders, in work-order id order."""
    engineer = F.when(truthy("assigned_engineer_id"), F.col("work_order_id"))
    return work_orders.groupBy("incident_id").agg(
        F.min_by("assigned_team", "work_order_id").alias("first_team"),
        F.min_by("assigned_engineer_id", engineer).alias("first_engineer"),
    )


def current_status(
    incidents: DataFrame,
    assets: DataFrame,
    leads: DataFrame,
    work_orders: DataFrame,
    as_of: Column,
) -> DataFrame:
    """Where each incident stands: its last record in its current stage, delay flags and next owner."""
    last = leads.groupBy("incident_id", F.col("stage").alias("current_stage")).agg(
        F.max_by(
            F.struct("entered_at", "duration_hours", "delay_hours", "is_bottleneck"),
            F.struct("entered_at", "event_id"),
        ).alias("rec")
    )
    stage = F.col("current_stage")
    owner = F.when(stage == "REPAIR_IN_PROGRESS", F.col("first_engineer")).when(
        stage.isin("ENGINEER_ASSIGNED", "SPARE_VENDOR_WAITING"), F.col("first_team")
    )
    return (
        incidents.join(last, ["incident_id", "current_stage"])
        .join(assets.select("asset_id"), "asset_id", "left_semi")
        .join(work_order_owners(work_orders), "incident_id", "left")
        .select(
            "incident_id",
            "asset_id",
            "zone_id",
            "current_stage",
            "current_status",
            F.col("rec.entered_at").alias("stage_entered_at"),
            round_even("rec.duration_hours", 2).alias("hours_in_current_stage"),
            (F.col("rec.is_bottleneck") | (F.col("needed_by_at") < as_of)).alias("is_delayed"),
            round_even("rec.delay_hours", 2).alias("delay_hours"),
            "needed_by_at",
            "priority_level",
            "business_impact",
            lookup("current_stage", vocab.OWNER_TYPE, "UNKNOWN").alias("next_owner_type"),
            owner.alias("next_owner_id"),
        )
    )
