"""Keys too large for one task: the chunked paths must give what the plain ones give."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import followup, reconcile, skew, summaries, validators, workflow
from faultline.vocab import EXIT_EVENT, STAGES

AS_OF = datetime(2026, 3, 1)


@pytest.fixture(scope="module")
def events(spark):
    """Random histories; one incident holds most events, many at equal times."""
    rng = random.Random(5)
    types = ["ENTERED_STAGE", "INCIDENT_RESTORED", "REDUNDANCY_LOST", *EXIT_EVENT.values()]
    rows = []
    for n in range(600):
        incident = "INC-HOT" if n % 3 else f"INC-{n % 10}"
        stage = STAGES[min(n // 20 % 7, 6)] if rng.random() < 0.9 else rng.choice(STAGES)
        kind = rng.choice([*types, "ENTERED_STAGE", EXIT_EVENT.get(stage, "INCIDENT_RESTORED")])
        at = datetime(2026, 1, 1) + timedelta(minutes=30 * (n // 4))
        rows.append((f"E{rng.randrange(10**6):06d}-{n}", incident, stage, kind, "SUCCESS", at, "S", None, None, None, "x"))
    return spark.createDataFrame(rows, schemas.CORE["events"]).repartition(3).cache()


def by_loop(events):
    """Stage exits the slow way, event by event."""
    grouped = {}
    for row in events.collect():
        grouped.setdefault(row.incident_id, []).append(row)
    result = set()
    for incident, rows in grouped.items():
        rows.sort(key=lambda r: (r.occurred_at, r.event_id))
        for i, row in enumerate(rows):
            if row.event_type != "ENTERED_STAGE":
                continue
            found = None
            for later in rows[i + 1 :]:
                if later.stage != row.stage:
                    break
                if later.event_type in (EXIT_EVENT.get(row.stage), "INCIDENT_RESTORED"):
                    found = later.occurred_at
                    break
            result.add((incident, row.event_id, row.stage, found))
    return result


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


@pytest.mark.parametrize("limit", [20, 10_000])
def test_lead_times_with_a_hot_incident(events, limit):
    leads = workflow.lead_times(events, AS_OF, hot_rows=limit)
    assert set(rows(leads, "incident_id", "event_id", "stage", "exited_at")) == by_loop(events)


def test_progression_is_the_same_in_chunks(events):
    plain = validators.stage_progression(events, None)
    assert rows(validators.stage_progression(events, 20)) == rows(plain)


def test_one_issue_per_stage_and_all_its_events_in_the_long_table(spark, events):
    entered = {}
    for r in sorted(validators.entered_events(events).collect(), key=lambda r: (r.occurred_at, r.event_id)):
        entered.setdefault((r.incident_id, r.stage), []).append(r.event_id)
    repeated = {k: v for k, v in entered.items() if len(v) > 1}
    found = validators.duplicate_stage_entries(events).collect()
    assert len(found) == len(repeated) and any(len(v) > 10 for v in repeated.values())
    for r in found:
        evidence = json.loads(r.evidence_json)
        ids = repeated[r.incident_id, evidence["stage"]]
        assert (evidence["event_count"], evidence["first_event_id"], evidence["last_event_id"]) == (len(ids), ids[0], ids[-1])
    incidents = spark.createDataFrame([], schemas.CORE["incidents"])
    orders = spark.createDataFrame([], schemas.CORE["work_orders"])
    long = reconcile.issue_evidence(incidents, events, orders)
    assert sorted((r.incident_id, r.stage, r.record_id) for r in long.collect()) == sorted(
        (*k, i) for k, v in repeated.items() for i in v
    )


def test_global_rank_matches_a_sort(spark):
    rng = random.Random(1)
    values = [(rng.choice([1.0, 2.0, 2.0]), f"k{n}") for n in range(500)]
    df = spark.createDataFrame(values, "score DOUBLE, id STRING").repartition(7)
    ranked = skew.global_rank(df, [F.desc("score"), F.asc("id")], "rank")
    expected = sorted(values, key=lambda v: (-v[0], v[1]))
    assert [(r.score, r.id) for r in ranked.orderBy("rank").collect()] == expected
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(1, 501))


def test_nearest_rank_narrows_to_the_exact_value(spark):
    rng = random.Random(2)
    data = {g: [rng.randrange(10**11) for _ in range(n)] for g, n in (("a", 1), ("b", 6), ("c", 300))}
    data["c"] += [data["c"][0]] * 50
    freq = (
        spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g STRING, v BIGINT")
        .groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    found = {r.g: r.picked for r in skew.nearest_rank(freq, ["g"], "v", "n", 0.9).collect()}
    assert found == {g: sorted(vs)[round((len(vs) - 1) * 0.9)] for g, vs in data.items()}


def test_bottlenecks_do_not_depend_on_the_limit(spark, core):
    as_of = workflow.default_as_of(core["events"])
    leads = workflow.lead_times(core["events"])

    def summary(limit):
        return summaries.bottleneck_summary(
            leads, core["incidents"], core["assets"], core["zones"], core["work_orders"], core["spares"], as_of, limit
        )

    assert rows(summary(1)) == rows(summary(10**6))


def test_spare_risk_equals_the_ordered_fold(spark):
    rng = random.Random(3)
    statuses = ["ASSIGNED", "WAITING_SPARE_VENDOR", "IN_PROGRESS"]
    spares = [(f"S{i}", rng.choice(["IN_STOCK", "LOW_STOCK", "OUT_OF_STOCK"]), rng.random() < 0.4) for i in range(12)]
    orders = [
        (f"W{n:03d}", f"I{n % 17}", rng.choice(statuses), rng.choice([s[0] for s in spares] + [None, ""]))
        for n in range(70)
    ]
    info = {s[0]: s for s in spares}
    expected = {}
    for key, incident, status, spare in sorted(orders):
        score = expected.get(incident, 0)
        _, stock, critical = info.get(spare, (None, None, False))
        if status == "WAITING_SPARE_VENDOR":
            score = max(score, 14)
        score = max(score, {"OUT_OF_STOCK": 18, "LOW_STOCK": 10}.get(stock, 0))
        expected[incident] = score + (4 if critical else 0)
    found = followup.spare_risk(
        spark.createDataFrame(
            orders, "work_order_id STRING, incident_id STRING, work_order_status STRING, required_spare_id STRING"
        ),
        spark.createDataFrame(spares, "spare_id STRING, stock_status STRING, critical_spare BOOLEAN"),
    )
    found = {r.incident_id: r.spare_risk for r in found.collect()}
    assert {k: min(v, 22) for k, v in expected.items() if v} == {k: v for k, v in found.items() if v}


def test_rows_without_key_are_spread(spark):
    """Nine tenths of the rows have no key: they stay, match nothing, and no task gets most of them."""
    from faultline.operators.core import keep_known
    from faultline.operators.skew import spread_nulls

    rows = spark.range(20000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'K' || (id % 40) WHEN id % 10 = 1 THEN '' END AS ref")
    known = spark.createDataFrame([("K0",), ("K20",)], "k string")
    kept = keep_known(rows, "ref", known, "k", optional=True)
    assert kept.columns == ["id", "ref"]
    assert kept.count() == 18000 + sum(1 for i in range(0, 20000, 10) if i % 40 in (0, 20))
    key = spread_nulls(F.nullif(F.col("ref"), F.lit("")), "id")
    sizes = [r.n for r in rows.select(key.alias("key")).repartition(16, "key").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_class_check_with_one_object_in_most_values(spark):
    """One stage node stands in nine tenths of the values; typed it gives no row, untyped one for each value."""
    from faultline.operators import shapes

    ont, iri = shapes.ONTOLOGY, "iri"
    stage = [(f"i{k}", ont + "hasCurrentStage", "stage:a" if k % 10 else f"stage:{k}", iri, None) for k in range(500)]
    types = [(f"i{k}", ont + "InfrastructureIncident") for k in range(500)] + [(f"stage:{k}", ont + "WorkflowStage") for k in range(0, 500, 10)]
    triples = spark.createDataFrame(stage, "s string, p string, o string, o_kind string, o_datatype string")
    for extra, wrong in (([], 450), ([("stage:a", ont + "WorkflowStage")], 0)):
        typed = spark.createDataFrame(types + extra, "node string, class string")
        report = shapes.validation_report(triples, shapes.CONTRACT_SHAPES, typed)
        found = report.where("component = 'class'").collect()
        assert len(found) == wrong
