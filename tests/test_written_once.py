"""Tables that several steps read are written once, as compressed columns; no step evaluates its input twice."""

import os

from pyspark.sql import functions as F

import workload
from faultline import schemas
from faultline.functions.scalar import explode_present, is_iso
from faultline.operators import findings, quality, raw_load, shapes, skew
from faultline.operators.core import _name_types
from faultline.operators.validators import emit, issue
from faultline.session import checkpoint, shared_folder
from faultline.sources.contracts import RAW_FEEDS
from faultline.vocab import SOURCE_SYSTEM


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def evaluations(spark, df, work) -> tuple[int, list]:
    """How often ``work`` evaluates each row of ``df``."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = work(df.mapInArrow(count, df.schema)).collect()
    return seen.value, rows


def test_checkpoint_is_parquet(spark):
    df = checkpoint(spark.range(100).select("id", F.lit("x" * 200).alias("text")))
    assert "parquet" in plan_of(df).lower() and df.count() == 100
    steps = [name for name in os.listdir(shared_folder(spark)) if name.startswith("step-")]
    assert steps


def test_rank_evaluates_its_input_once(spark):
    n, rows = evaluations(spark, spark.range(50, numPartitions=4), lambda df: skew.global_rank(df, [F.desc("id")], "n"))
    assert n == 50
    assert {r.n: r.id for r in rows} == {i + 1: 49 - i for i in range(50)}


def test_check_results_evaluate_failures_once(spark):
    failures = spark.range(30, numPartitions=3).select(
        (F.col("id") % 2 + 1).cast("int").alias("check_number"),
        F.format_string("K%02d", "id").alias("failed_key"),
        F.lit(1).cast("bigint").alias("failed_rows"),
    )
    n, rows = evaluations(spark, failures, lambda df: quality.check_results(df, "R"))
    assert n == 30
    found = {r.check_result_id: r for r in rows}
    assert len(found) == 41 and found["DQ-R-001"].failed_row_count == 15
    assert found["DQ-R-002"].sample_failed_keys[:2] == ["K01", "K03"]


def test_places_alone_need_no_payload(spark):
    records = spark.createDataFrame(
        [("s", "1", '{"a":1}', 2), ("s", "1", '{"a":2}', 1), ("s", "2", '{"a":3}', 0), ("s", "3", "oops", 0)],
        "source_system STRING, source_record_id STRING, payload STRING, position INT",
    )
    loaded, _ = raw_load.split_duplicates(records, None)
    places = loaded.select("source_record_id", "position")
    plan = plan_of(places)
    assert "min_by" not in plan and "SortAggregate" not in plan
    assert sorted(map(tuple, places.collect())) == [("1", 1), ("2", 0)]
    assert sorted(r.payload for r in loaded.collect()) == ['{"a":2}', '{"a":3}']


def test_emit_filters_before_it_builds_arrays(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "n INT")
    row = issue("k", "m", F.col("n").cast("string"), None)
    rows = emit(df, (F.col("n") > 0, row), (F.col("n") > 3, row))
    assert "Filter" in plan_of(rows) and sorted(r.evidence_json for r in rows.collect()) == ["1", "5", "5"]


def test_iso_forms_with_and_without_minutes(spark):
    texts = {"2024-01-02": True, "2024-01-02T03": True, "2024-01-02T03:04": True,
             "2024-01-02T03:04:05.5+01:00": True, "2024-01-02T25:00": False, "not-a-date": False, "2024-1-2": False}
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", is_iso("t").alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == texts


def test_outcomes_are_one_join(spark):
    facts = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p")], "s STRING, p STRING")
    bad = spark.createDataFrame([("a",), ("a",)], "focus STRING")
    both = findings.outcomes(facts, bad)
    assert plan_of(both).count("Join") == 1
    assert sorted((r.s, r.p, r.outcome) for r in both.collect()) == [
        ("a", "p", "quarantined"), ("a", "q", "quarantined"), ("b", "p", "promoted")]


def test_items_are_built_once_and_compiled(spark):
    """No generator or higher-order function holds the expressions, which Spark would interpret row by row."""
    df = spark.range(4).select("id", F.concat(F.lit("k"), "id").alias("k"))
    items = [F.when(F.col("id") > 1, F.struct(F.lower("k").alias("k"))), F.when(F.col("id") > 2, F.struct(F.upper("k").alias("k")))]
    found = explode_present(df, items, "f", "id").select("id", "f.k")
    assert sorted(tuple(r) for r in found.collect()) == [(2, "k2"), (3, "K3"), (3, "k3")]
    assert "lambda" not in plan_of(found) and plan_of(found).count("upper(") == 1
    issues = emit(df, (F.col("id") > 2, issue("a", "text", F.lit("{}"), incident="k")))
    assert "lambda" not in plan_of(issues)


def test_raw_records_are_made_once_for_all_flaws(spark):
    """One pass over keys for copies, one over payloads for everything else, references included."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "source_system STRING, source_record_id STRING, payload STRING, position INT"
    empty = spark.createDataFrame([], schema)
    raw = {feed.core: empty for feed in RAW_FEEDS}
    raw["incidents"] = spark.createDataFrame([(SOURCE_SYSTEM, "1", '{"incident_id":"INC-1"}', 0)], schema)
    events = [
        (SOURCE_SYSTEM, "2", '{"incident_id":"INC-1","occurred_at":"bad"}', 0), (SOURCE_SYSTEM, "3", "oops", 0),
        (SOURCE_SYSTEM, "4", '{"incident_id":"INC-2","occurred_at":"2024-01-01"}', 0), ("other", "5", '{"incident_id":"INC-1"}', 0),
    ]
    raw["events"] = spark.createDataFrame(events, schema).mapInArrow(count, schema)
    rows = quality.raw_failures(raw).collect()
    assert seen.value == 2 * len(events)
    number = quality.check_number("missing_infrastructure_request_reference", "raw_incident_stage_events")
    assert sorted(r.failed_key for r in rows if r.check_number == number) == [f"{SOURCE_SYSTEM}:3", f"{SOURCE_SYSTEM}:4"]
    dates = quality.check_number("invalid_date_format", "raw_incident_stage_events")
    assert [r.failed_key for r in rows if r.check_number == dates] == [f"{SOURCE_SYSTEM}:2 field=occurred_at"]


def test_findings_are_made_from_a_set(spark):
    """Findings are not shuffled for being told apart: what they are made of is a set before."""
    o, iri = shapes.ONTOLOGY, "iri"
    facts = [("i", "affectsAsset", "a"), ("i", "hasCurrentStage", "s"), ("i", "hasCurrentStage", "t"), ("e", "hasDependentAsset", "a"),
             ("e", "hasDependencyAsset", "b"), ("p", "hasPathStep", "e"), ("q", "hasPathStep", "e"), ("i", "affectsAsset", "a")]
    triples = spark.createDataFrame([(s, o + p, x, iri) for s, p, x in facts], "s STRING, p STRING, o STRING, o_kind STRING")
    classes = [("i", "InfrastructureIncident"), ("p", "DependencyPath"), ("q", "DependencyPath")]
    types = spark.createDataFrame([(n, o + c) for n, c in classes], "node STRING, class STRING")
    assert sorted(r.derived_from for r in findings.dependency_exposure(triples, types).collect()) == ["i", "p", "q"]
    made = sorted(r.finding_type for r in findings.recovery_blocker(triples, types).collect())
    assert made == ["FollowUpDecision", "RecoveryBlocker", "RecoveryBlocker"]
    for rule in (findings.dependency_exposure, findings.recovery_blocker):
        plan = rule(triples, types)._jdf.queryExecution().optimizedPlan().toString()
        keys = [line.split("Aggregate [")[1].split("]")[0] for line in plan.split("\n") if "Aggregate [" in line]
        assert keys and not any(name in key for key in keys for name in ("finding", "text", "derived_from"))


def test_conformance_asks_kinds_until_one_fails(spark):
    o = shapes.ONTOLOGY
    schema = "s STRING, p STRING, o STRING, o_kind STRING, o_datatype STRING"
    good = [("z", shapes.RDF_TYPE, "C", "iri", None)]
    bad = [("i", o + "hasCurrentStage", "x", "literal", None)]
    for rows in (good, bad, good + bad):
        triples = spark.createDataFrame(rows, schema)
        report = shapes.validation_report(triples, shapes.CONTRACT_SHAPES)
        assert shapes.conforms(triples, shapes.CONTRACT_SHAPES) == (report.count() == 0)


def test_one_check_computes_one_check(spark):
    """The other checks' rules are not run for it, and its result is the one among all."""
    def counting(df, seen):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema)

    schema = "source_system STRING, source_record_id STRING, payload STRING, position INT"
    model, seen = object.__new__(workload.Model), spark.sparkContext.accumulator(0)
    model.core = {name: spark.createDataFrame([], ddl) for name, ddl in schemas.CORE.items()}

    def rows(name, **values):
        rest = [f"CAST(NULL AS {kind}) AS {n}" for n, kind in _name_types(schemas.CORE[name])[len(values):]]
        return spark.range(1).selectExpr(*[f"'{value}' AS {n}" for n, value in values.items()], *rest)

    model.core["events"] = rows("events", event_id="E1", incident_id="I1", stage="RESTORED", event_type="ENTERED_STAGE")
    model.core["validations"] = counting(rows("validations", validation_id="V", incident_id="I1"), seen)
    model.raw = lambda: {feed.core: counting(spark.createDataFrame([("s", "1", "{}", 0)], schema), seen) for feed in RAW_FEEDS}
    every = {r.check_result_id: r for r in model.checks().collect()}
    assert len(every) == 41 and seen.value > 1
    for number, read in ((30, 0), (39, 1)):
        before, result = seen.value, f"DQ-RUN-1-0{number}"
        assert model.checks(only=number).collect() == [every[result]] and every[result].failed_row_count == 1
        assert seen.value - before == read
    assert model.checks(only=3).collect() == [every["DQ-RUN-1-003"]]


def test_references_are_read_from_the_fields_parsed(spark):
    """A record's JSON is parsed once, also for its reference."""
    schema = "source_system STRING, source_record_id STRING, payload STRING, position INT"
    raw = {feed.core: spark.createDataFrame([], schema) for feed in RAW_FEEDS}
    plan = quality.raw_failures(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan


def test_classes_meet_as_one_row_per_node(spark):
    """A node's classes are told apart without being rows of a shuffle, and a report asks each node once."""
    o, schema = shapes.ONTOLOGY, "s STRING, p STRING, o STRING, o_kind STRING, o_datatype STRING"
    rows = [("i", o + "affectsAsset", "a", "iri", None), ("i", o + "affectsAsset", "b", "iri", None),
            ("i", o + "hasCurrentStage", "x", "literal", None), ("z", shapes.RDF_TYPE, "C", "iri", None)]
    triples = spark.createDataFrame(rows, schema)
    types = shapes.entailed_types(triples, shapes.CONTRACT_SHAPES)
    plan = types._jdf.queryExecution().optimizedPlan().toString()
    assert any("bit_or" in line and "Aggregate [node" in line for line in plan.split("\n"))
    found = {(r.node, r["class"].removeprefix(o)) for r in types.collect()}
    assert {("i", "InfrastructureIncident"), ("a", "InfrastructureAsset"), ("a", "OperationalEntity"), ("z", "C")} <= found
    only = shapes.entailed_types(triples, shapes.CONTRACT_SHAPES, ["InfrastructureAsset"]).collect()
    assert {(r.node, r["class"]) for r in only} == {(n, o + "InfrastructureAsset") for n in "ab"}
    for given in (None, types):
        report = shapes.validation_report(triples, shapes.CONTRACT_SHAPES, given)
        got = sorted((r.focus_node, r.component, r.value, r.message) for r in report.collect() if r.focus_node == "i")
        assert got == [("i", "class", "x", f"value is not a {o}WorkflowStage"), ("i", "maxCount", None, "more than 1 values"),
                       ("i", "or", None, "needs prov:wasDerivedFrom or prov:wasGeneratedBy")]


def test_rules_make_only_the_facts_they_read(spark):
    core = {name: spark.createDataFrame([], ddl) for name, ddl in schemas.CORE.items()}

    def rows(name, **values):
        kinds = dict(_name_types(schemas.CORE[name]))
        columns = [f"CAST({repr(values[n]) if n in values else 'NULL'} AS {kind}) AS {n}" for n, kind in kinds.items()]
        return spark.range(1).selectExpr(*columns)

    twice = [rows("incidents", incident_id="I", asset_id=a, current_stage="RESTORED") for a in "ABA"]
    core["incidents"] = twice[0].unionByName(twice[1]).unionByName(twice[2])
    core["snapshots"] = rows("snapshots", impact_snapshot_id="S", incident_id="I", affected_gpu_count="3")
    full = checkpoint(findings.canonical_triples(core))
    assert full.count() == full.distinct().count()  # an incident of three rows has each of its facts once
    types = checkpoint(shapes.entailed_types(full, shapes.CONTRACT_SHAPES))
    for rule in (findings.recovery_blocker, findings.impact_trust):
        triples, asked = findings.rule_facts(core, rule)
        assert {r.p.removeprefix(shapes.ONTOLOGY) for r in triples.select("p").collect()} <= set(findings.RULE_PREDICATES[rule])
        assert sorted(rule(triples, asked).collect()) == sorted(rule(full, types).collect())
        assert not rule(full, types).isEmpty()


def test_provenance_makes_only_its_facts(spark):
    found = spark.createDataFrame(
        [("f", "RecoveryBlocker", "t", "a"), ("f", "RecoveryBlocker", "t", "b"), ("g", "FollowUpDecision", "u", None)],
        findings.FINDING_COLUMNS,
    )
    every, only = findings.finding_triples(found, "run"), findings.finding_triples(found, "run", findings.PROV)
    assert every.count() == every.distinct().count() == 13 and only.where(~F.col("p").startswith(findings.PROV)).isEmpty()
    assert sorted(findings.provenance_edges(only).collect()) == sorted(findings.provenance_edges(every).collect())
