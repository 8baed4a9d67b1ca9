"""Parts of a large result are written one after the other: local disks hold the shuffle files of one of them at a time."""

from pyspark.sql import functions as F

import workload
from faultline.operators import quality, reconcile

FOLDER = "/root/testdata/sf0.001"


def test_checks_write_their_parts_apart(spark, monkeypatch):
    keys = spark.range(30, numPartitions=3).select(
        (F.col("id") % 2 + 1).cast("int").alias("check_number"),
        F.format_string("K%02d", "id").alias("failed_key"),
        F.lit(1).cast("bigint").alias("failed_rows"),
    )
    written, write = [], quality.checkpoint
    monkeypatch.setattr(quality, "checkpoint", lambda df: written.append(df) or write(df))
    parts = [keys.where("check_number = 1"), keys.where("check_number = 2")]
    apart = quality.check_results(parts, "R").orderBy("check_result_id").collect()
    assert len(written) == 2
    assert apart == quality.check_results(keys, "R").orderBy("check_result_id").collect()


def test_parts_are_the_whole(spark):
    m = workload.Model(spark, FOLDER)
    raw, core = m.raw(), m.core
    assert len(quality.raw_failure_parts(raw)) == 5 and len(quality.core_failure_parts(core)) == 2
    assert len(quality.core_failure_parts(core, first=30, last=30)) == 1
    tables = m.incidents, m.events, m.work_orders, m.validations, m.snapshots, m.status
    assert len(reconcile.issue_parts(*tables)) == 3


def test_bottlenecks_read_written_lead_times(spark):
    m = workload.Model(spark, FOLDER).with_leads("incident_id", "stage", "duration_us")
    assert m.leads.columns == ["incident_id", "stage", "duration_us"]
    plan = m.analytics.bottleneck_summary()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("FileScan parquet [incident_id#", 1)[1] and "lag(" not in plan
