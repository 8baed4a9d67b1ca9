"""Runs that add up: late parents, redelivered keys, partitions read and written."""

import json
import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators.core import _name_types
from faultline.plans import batch
from faultline.sources.contracts import FEED_BY_CORE
from faultline.sources.keyed import KeyIndex
from faultline.sources.warehouse import Warehouse

FEEDS = ["incidents", "work_orders"]


def record(name, key, at=0, **values):
    """One raw record with every field filled in."""
    kinds = dict(_name_types(schemas.CORE[name]))
    fill = lambda f: "2030-01-01T00:00:00Z" if kinds.get(f, "").startswith("TIMESTAMP") else "1" if "DOUBLE" in kinds.get(f, "") else "x"
    payload = {f: fill(f) for f in FEED_BY_CORE[name].fields} | {schemas.PRIMARY_KEY[name]: key} | values
    return ("sys", f"S-{values.pop('source', key)}", json.dumps(payload), at)


def feed(spark, rows):
    df = spark.createDataFrame(rows, "source_system string, source_record_id string, payload string, at long")
    place = F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("block"), F.col("at").alias("row"))
    return df.select("source_system", "source_record_id", "payload", place.alias("position"))


def incident(i, at=0, **values):
    return record("incidents", f"I{i}", at, asset_id="A", zone_id="Z", **values)


def order(i, of, at=0, **values):
    return record("work_orders", f"W{i}", at, incident_id=f"I{of}", assigned_engineer_id="", required_spare_id="", **values)


@pytest.fixture(scope="module")
def known(spark):
    one = {"zones": "Z", "assets": "A", "engineers": "E", "spares": "P", "dependencies": "D"}
    return {n: spark.createDataFrame([(v,)], f"{schemas.PRIMARY_KEY[n]} string") for n, v in one.items()}


def load(spark, root, known, runs):
    for n, (incidents, orders) in enumerate(runs, 1):
        house = Warehouse(spark, root, buckets=16)
        batch.load_raw(house, {"incidents": feed(spark, incidents), "work_orders": feed(spark, orders)}, f"RUN-{n}")
        batch.load_payloads(house, f"RUN-{n}", datetime(2030, 1, n), known)
        counts = house.write_run_part(batch.layer_counts(house), "ops/counts", f"RUN-{n}")
        house.append_run({"pipeline_run_id": f"RUN-{n}", "started_at": datetime(2030, 1, n)} | batch.ledger_counts(house, counts))
    return Warehouse(spark, root, buckets=16)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_two_runs_equal_one(spark, tmp_path, known):
    first = [incident(i) for i in range(0, 20, 2)], [order(i, i % 20) for i in range(40)]
    second = [incident(i) for i in range(20)], [order(i, i % 20) for i in range(30, 60)] + [order(100, 99)]
    two = load(spark, str(tmp_path / "two"), known, [first, second])
    one = load(spark, str(tmp_path / "one"), known, [(first[0] + second[0], first[1] + second[1])])
    for name in FEEDS:
        assert rows(two.core(name)) == rows(one.core(name)), name
    assert two.core("work_orders").count() == 60
    assert [r.incident_id for r in two.core("incidents").orderBy("incident_id").limit(1).collect()] == ["I0"]
    counts = {(r.pipeline_run_id, r.layer, r.table_name): r.rows for r in two.run_parts("ops/counts").collect()}
    assert (counts["RUN-1", "accepted", "work_orders"], counts["RUN-1", "waiting", "work_orders"]) == (20, 20)
    assert (counts["RUN-2", "raw/work_orders", ""], counts["RUN-2", "rejects/work_orders", ""]) == (21, 10)
    assert (counts["RUN-2", "accepted", "work_orders"], counts["RUN-2", "waiting", "work_orders"]) == (40, 1)
    last = two.runs().where("pipeline_run_id = 'RUN-2'").first()
    assert (last.core_records_loaded, last.core_records_skipped, last.rows_rejected) == (80, 1, 20)


def test_the_later_row_wins_even_if_an_earlier_one_had_to_wait(spark, tmp_path, known):
    """Two records of one work order: the earlier waits for its incident and must not overwrite the later one."""
    runs = [
        ([incident(1)], [order(7, 2, source="a", assigned_team="early")]),
        ([], [order(7, 1, source="b", assigned_team="late")]),
        ([incident(2)], []),
    ]
    house = load(spark, str(tmp_path), known, runs)
    assert [r.assigned_team for r in house.core("work_orders").collect()] == ["late"]
    assert house.snapshot("waiting", "work_orders").count() == 0


def test_a_run_touches_only_what_it_brings(spark, tmp_path, known):
    many = [incident(i) for i in range(200)], [order(i, i) for i in range(200)]
    house = load(spark, str(tmp_path), known, [many, ([incident(1000)], [order(1000, 1000)])])
    assert sum(run == "RUN-2" for run in house.core_parts("work_orders").values()) == 1
    assert len(house.core_parts("work_orders")) == 16 and house.core("work_orders").count() == 201
    # what waits or is new is all the payload that the next run would parse
    assert house.snapshot("waiting", "work_orders").count() == 0
    index = house.key_index("work_orders")
    new = feed(spark, [order(i, 0) for i in range(5000, 5040)])
    assert len(index.touched(new, house.committed_parts)) <= 2
    again = feed(spark, [order(3, 0), order(5001, 0)])
    stored = index.stored_among(again, house.committed_parts)
    assert len(index.touched(again, house.committed_parts)) <= 2
    assert stored.where("source_record_id = 'S-W3'").count() == 1 and stored.count() < 100
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]


def test_full_bit_tables_cost_reads_not_answers(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path), buckets=4, words=1)
    keys = spark.range(500).selectExpr("'s' AS source_system", "CAST(id AS STRING) AS source_record_id")
    index.add(keys.where("source_record_id < '3'"), "a")
    index.add(keys.where("source_record_id >= '3'"), "b")
    every = index.stored_among(keys, lambda df: df)
    assert every.distinct().count() == 500
    early = index.stored_among(keys, lambda df: df.where("part = 'a'"))
    assert early.count() == keys.where("source_record_id < '3'").count()
    index.add(keys.limit(0), "c")
    assert index.stored_among(keys.limit(0), lambda df: df).count() == 0


def test_a_run_keeps_no_working_copies(spark, tmp_path, known):
    """Accepted and changed rows stand in core, so their copies go; nothing that a later run reads goes with them."""
    runs = [([incident(1)], [order(7, 1), order(8, 2)]), ([incident(2)], [order(7, 1, source="b", assigned_team="new")])]
    house = load(spark, str(tmp_path), known, runs)
    for area in ("accepted", "changed"):
        assert not [f for _, _, files in os.walk(tmp_path / area) for f in files], area
    assert [(r.work_order_id, r.assigned_team) for r in house.core("work_orders").orderBy("work_order_id").collect()] == [("W7", "new"), ("W8", "x")]
    assert ("changed", "work_orders", 2) in [(r.layer, r.table_name, r.rows) for r in house.run_parts("ops/counts").collect()]


def test_shuffle_files_go_when_a_step_ends(spark):
    """A session that is configured doesn't leave them to the driver's garbage collection."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum(tracker.getAllBlocks().apply(i).isShuffle() for i in range(tracker.getAllBlocks().size()))
    before = count()
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.format("noop").mode("overwrite").save()
    for _ in range(50):
        if count() <= before:
            break
        time.sleep(0.1)
    assert count() <= before
