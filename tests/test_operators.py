"""Small cases of single operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions.scalar import encode_for_uri, is_iso, iso_text, parse_iso, round_even
from faultline.operators import findings, graph, shapes, validators, workflow
from faultline.operators.raw_load import split_duplicates
from faultline.plans import views

O, P, X = shapes.ONTOLOGY, shapes.PROV, graph.XSD
T = datetime(2026, 1, 1)


def event(n, stage, kind, incident="I1", at=None):
    return (f"E{n}", incident, stage, kind, "SUCCESS", at or T.replace(hour=n), "S", None, None, None, "x")


def test_iso_text_and_checks(spark):
    texts = ["2026-01-05T11:00:00Z", "2026-01-05", "2026-01-05 11:00", "2026-01-05T11:00:00.25+02:00", "2026",
             "2026-1-5", "2026-02-30", "tomorrow", "2026-01-05T25:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert [r[0] for r in df.select(is_iso("t")).collect()] == [True] * 4 + [False] * 5
    times = spark.createDataFrame([(T,), (T.replace(microsecond=5),)], "t TIMESTAMP_NTZ")
    assert [r[0] for r in times.select(iso_text("t")).collect()] == [t[0].isoformat() for t in times.collect()]


def test_core_dates_are_strict(spark):
    def parsed(text):
        return spark.createDataFrame([(text,)], "t STRING").select(parse_iso("t").alias("t")).first().t

    assert parsed("2026-01-05T11:00:00.25+02:00") == datetime(2026, 1, 5, 9, 0, 0, 250000)
    assert parsed("2026-01-05") == datetime(2026, 1, 5) and parsed("2026-01-05 11") == datetime(2026, 1, 5, 11)
    assert parsed(None) is None
    for bad in ("2026", "2026-1-5", "2026-02-30", "tomorrow"):
        with pytest.raises(Exception, match="not an ISO date"):
            parsed(bad)


def test_ties_round_to_even(spark):
    df = spark.createDataFrame([(262.5, 85.25, 0.125), (263.5, 85.75, 0.375)], "a DOUBLE, b DOUBLE, c DOUBLE")
    found = df.select(round_even("a"), round_even("b", 1), round_even("c", 2)).collect()
    assert [tuple(r) for r in found] == [(262.0, 85.2, 0.12), (264.0, 85.8, 0.38)]


def test_uri_encoding(spark):
    row = spark.createDataFrame([("a b*~/é:-_.",)], "v STRING").select(encode_for_uri("v")).first()
    assert row[0] == "a%20b%2A~%2F%C3%A9%3A-_."


def test_iri_cleaning_and_local_name(spark):
    df = spark.createDataFrame([(" AB c/é ",), ("",)], "v STRING").select(graph.iri("v").alias("i"))
    assert [r[0] for r in df.select(graph.local_name("i")).collect()] == ["AB-c-é", "unknown"]


def test_unordered_restore_shortcut_is_accepted_and_missing_evidence_is_not(spark):
    incidents = spark.createDataFrame(
        [("I1", "A", "RESTORED"), ("I2", "A", "RESTORED"), ("I3", "A", "IN_PROGRESS")],
        "incident_id STRING, asset_id STRING, current_status STRING",
    )
    events = spark.createDataFrame(
        [event(2, "RESTORED", "INCIDENT_RESTORED"), event(1, "INCIDENT_REPORTED", "ENTERED_STAGE"),
         event(3, "INCIDENT_REPORTED", "ENTERED_STAGE", "I2"), event(4, "RESTORED", "ENTERED_STAGE", "I3")],
        schemas.CORE["events"],
    )
    found = validators.restored_state(events, incidents)
    assert {r.incident_id for r in found.collect()} == {"I2", "I3"}


def test_equal_snapshot_times_follow_the_requested_tie(spark):
    df = spark.createDataFrame(
        [("S2", "I", T), ("S1", "I", T), ("S0", "I", datetime(2025, 1, 1))],
        "impact_snapshot_id STRING, incident_id STRING, snapshot_at TIMESTAMP_NTZ",
    )
    assert workflow.latest_snapshots(df, "asc").first().impact_snapshot_id == "S1"
    assert workflow.latest_snapshots(df, "desc").first().impact_snapshot_id == "S2"


def test_raw_duplicates_keep_the_first_and_skip_stored(spark):
    records = spark.createDataFrame(
        [("s", "1", "{}", 2), ("s", "1", '{"first":1}', 1), ("s", "2", "{}", 3), (None, "3", "{}", 4),
         ("s", "4", "text", 5)],
        "source_system STRING, source_record_id STRING, payload STRING, position INT",
    )
    stored = spark.createDataFrame([("s", "2")], "source_system STRING, source_record_id STRING")
    loaded, rejected = split_duplicates(records, stored)
    assert [r.payload for r in loaded.collect()] == ['{"first":1}']
    assert sorted((str(r.source_record_id), r.rejected_rows) for r in rejected.collect()) == [
        ("1", 1), ("2", 1), ("None", 2)]


def test_blast_radius(core):
    reach = graph.downstream_assets(core["dependencies"])
    assert {(r.origin, r.asset) for r in reach.collect()} == {("PUMP-1", "PUMP-2"), ("PUMP-1", "VALVE"), ("PUMP-2", "VALVE")}


def test_blast_radius_ends_on_cycles(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "a"), ("f", "e"), ("g", "f"), ("h", "g"), ("i", "h")],
        "dependent_asset_id STRING, dependency_asset_id STRING",
    )
    reach = graph.downstream_assets(edges, spark.createDataFrame([("a",)], "origin STRING"))
    assert {r.asset for r in reach.collect()} == {"b", "c", "e", "f", "g", "h", "i"}


def test_runtime_shapes(core):
    triples = graph.core_triples(core)
    assert shapes.validation_report(triples, shapes.RUNTIME_SHAPES).count() == 0
    broken = triples.where(
        ~((F.col("s") == graph.RUNTIME + "P2") & (F.col("p") == graph.RUNTIME + "affectsAsset"))
    )
    report = shapes.validation_report(broken, shapes.RUNTIME_SHAPES)
    assert [(r.focus_node, r.result_path) for r in report.collect()] == [("P2", "affectsAsset")]


def facts(spark, text):
    """Lines of "subject predicate object"; quoted objects are literals, ``^^type`` gives their datatype."""
    rows = []
    for line in filter(None, map(str.strip, text.splitlines())):
        s, p, o = line.split(" ", 2)
        p = graph.RDF_TYPE if p == "a" else P + p[5:] if p.startswith("prov:") else O + p
        if o.startswith('"'):
            value, _, datatype = o[1:].partition('"')
            rows.append((s, p, value, "literal", X + (datatype[2:] or "string")))
        else:
            rows.append((s, p, O + o if p == graph.RDF_TYPE else o, "iri", None))
    return spark.createDataFrame(rows, "s STRING, p STRING, o STRING, o_kind STRING, o_datatype STRING")


BASE = """
sys a SourceSystem
run a ImportActivity
src a SourceRecord
src hasSourceRecordId "SRC-1"
src hasSourceSystem sys
src prov:wasGeneratedBy run
zone a InfrastructureZone
zone prov:wasDerivedFrom src
asset a InfrastructureAsset
asset hasIdentifier "A"
asset locatedIn zone
asset prov:wasDerivedFrom src
stage a WorkflowStage
inc a InfrastructureIncident
inc prov:wasDerivedFrom src
"""
INCIDENT = BASE + """
inc affectsAsset asset
inc hasCurrentStage stage
"""
TOPOLOGY = INCIDENT + """
pdu a PowerAsset
pdu hasIdentifier "P"
pdu locatedIn zone
pdu prov:wasDerivedFrom src
edge a DependencyEdge
edge hasDependentAsset asset
edge hasDependencyAsset pdu
edge hasDependencyRole "POWER"
edge prov:wasDerivedFrom src
path a PowerPath
path hasPathStep edge
path prov:wasDerivedFrom src
"""
FINDING = INCIDENT + """
act a ReasoningActivity
act prov:used inc
act prov:generated f1
act prov:generatedAtTime "2026-06-07T00:00:00Z"^^dateTime
f1 a DependencyImpactFinding
f1 hasFindingSummary "text"
f1 prov:wasDerivedFrom inc
f1 prov:wasGeneratedBy act
"""


def problems(spark, text):
    report = shapes.validation_report(facts(spark, text), shapes.CONTRACT_SHAPES)
    return sorted((r.focus_node, str(r.result_path), r.component) for r in report.collect())


def test_contract_shapes(spark):
    assert problems(spark, INCIDENT) == []
    assert problems(spark, TOPOLOGY) == []
    assert problems(spark, FINDING) == []
    assert problems(spark, BASE + "inc hasCurrentStage stage") == [("inc", "urn:dcai:ontology:affectsAsset", "minCount")]
    unknown = BASE + 'inc affectsAsset asset\ninc hasCurrentStage "UNKNOWN_STAGE"'
    assert problems(spark, unknown) == [("inc", "urn:dcai:ontology:hasCurrentStage", "class")]
    proposal = [(f, p.rsplit(":", 1)[-1].rsplit("#")[-1], c) for f, p, c in problems(
        spark, 'x a ProposedTripleSet\nx proposesTriple "t"')]
    assert proposal == [("x", "None", "or"), ("x", "validatedAgainstShape", "minCount"),
                        ("x", "wasGeneratedBy", "minCount")]
    bare = [(f, c) for f, _, c in problems(
        spark, INCIDENT.replace("src prov:wasGeneratedBy run\n", "")
        + 'f1 a DependencyImpactFinding\nf1 hasFindingSummary "t"')]
    assert bare == [("f1", "or"), ("f1", "minCount"), ("f1", "minCount"), ("src", "or")]


def test_findings_follow_paths_of_any_subclass(spark):
    triples = facts(spark, TOPOLOGY)
    types = shapes.entailed_types(triples, shapes.CONTRACT_SHAPES)
    found = findings.dependency_exposure(triples, types).collect()
    assert {(r.finding, r.text, r.derived_from) for r in found} == {
        ("urn:dcai:reasoning:dependency-exposure:inc", "Dependency exposure from asset through pdu", "inc"),
        ("urn:dcai:reasoning:dependency-exposure:inc", "Dependency exposure from asset through pdu", "path"),
    }
    assert findings.blast_radius(triples, types).count() == 0


def test_older_runs_do_not_count(spark, batch):
    house = batch[1]
    issues, runs = house.run_parts("ops/issues"), house.runs()
    older = issues.withColumn("pipeline_run_id", F.lit("RUN-0"))
    both = issues.unionByName(older)
    assert views.impact_trust_flags(both, runs).count() == 2


def test_read_side_goldens(batch, core):
    house = batch[1]
    tables = {n: house.snapshot("analytics", n) for n in (
        "current_status", "stage_lead_times", "follow_up_queue", "bottleneck_summary", "asset_delay_summary",
        "zone_delay_summary", "spare_waiting_summary")}
    checks, issues, runs = house.run_parts("ops/checks"), house.run_parts("ops/issues"), house.runs()
    counts = views.impact_issue_counts(issues, runs)
    o = views.overview(
        core["incidents"], core["assets"], core["snapshots"], tables["current_status"], tables["bottleneck_summary"],
        tables["asset_delay_summary"], tables["spare_waiting_summary"], checks, runs).first()
    assert (o.total_requests, o.open_requests, o.delayed_requests, o.critical_asset_delayed) == (5, 4, 4, 1)
    assert (o.top_bottleneck_stage, o.repeat_failure_asset_count, o.capacity_risk_kw) == ("SPARE_VENDOR_WAITING", 1, 262.5)
    assert (o.affected_gpu_count, o.redundancy_lost_incidents, o.vendor_eta_missed_count) == (100, 1, 1)
    assert (o.latest_pipeline_run_status, o.data_quality_status) == ("PARTIAL_SUCCESS", "FAILED")
    s = views.impact_summary(core["incidents"], core["snapshots"], counts).first()
    assert s.incident_count == 2 and s.capacity_risk_kw == 262.5
    rows = views.follow_up_rows(
        tables["follow_up_queue"], core["incidents"], core["assets"], core["zones"], tables["current_status"],
        core["snapshots"], counts)
    late = views.filter_follow_ups(rows, delayed_only=True, limit=50)
    assert [r.incident_id for r in late.collect()] == ["P2", "P4", "P3"]
    detail = views.incident_detail("P1", core, tables, checks, issues, runs)
    header = detail["header"].first()
    assert (header.priority_rank, header.recommended_action) == (0, "No follow-up required")
    assert detail["timeline"].count() == 14
    flags = views.quality_flags(core["incidents"], checks, issues, runs)
    assert flags.where("incident_id = 'P3'").count() == 1
