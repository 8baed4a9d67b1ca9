"""Reasoning findings over canonical triples, their lineage, promotion and gates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import vocab
from faultline.functions.scalar import encode_for_uri, explode_present
from faultline.operators.graph import RDF_TYPE, XSD
from faultline.operators.shapes import CONTRACT_SHAPES, ONTOLOGY, PROV, entailed_types
from faultline.session import checkpoint

# --- fixed values: graph names, finding addresses and kinds ---------------------------------------
SOURCE_GRAPH = "urn:dcai:graph:source"
CANONICAL = "urn:dcai:graph:canonical"
REASONING = "urn:dcai:graph:reasoning"
PROVENANCE = "urn:dcai:graph:provenance"
FINDING_IRI = "urn:dcai:reasoning:"
FINDING_TYPES = [
    "DependencyImpactFinding",
    "RecoveryBlocker",
    "FollowUpDecision",
    "RestoreReadinessFinding",
    "TrustFinding",
    "BlastRadiusFinding",
]
FINDING_COLUMNS = "finding STRING, finding_type STRING, text STRING, derived_from STRING"


def _pairs(triples: DataFrame, predicate: str, subject: str, target: str) -> DataFrame:
    return triples.where(F.col("p") == ONTOLOGY + predicate).select(
        F.col("s").alias(subject), F.col("o").alias(target)
    )


def _members(types: DataFrame, class_name: str, alias: str) -> DataFrame:
    return types.where(F.col("class") == ONTOLOGY + class_name).select(F.col("node").alias(alias))


def _finding(kind: str, about: str) -> Column:
    return F.concat(F.lit(f"{FINDING_IRI}{kind}:"), encode_for_uri(about))


def _rows(df: DataFrame, finding: Column, finding_type: str, text: Column, source: str | Column) -> DataFrame:
    """(finding, finding_type, text, derived_from) of rows that are a set already, so no finding is shuffled."""
    return df.select(
        finding.alias("finding"),
        F.lit(finding_type).alias("finding_type"),
        text.alias("text"),
        (F.col(source) if isinstance(source, str) else source).alias("derived_from"),
    )


def _incident_assets(triples: DataFrame, types: DataFrame) -> DataFrame:
    return _pairs(triples, "affectsAsset", "incident", "asset").join(
        _members(types, "InfrastructureIncident", "incident"), "incident", "left_semi"
    ).distinct()


def _path_edges(triples: DataFrame, types: DataFrame) -> DataFrame:
    """(path, dependent, dependency): the edges of every path, subclasses of path included."""
    steps = _pairs(triples, "hasPathStep", "path", "edge").join(
        _members(types, "DependencyPath", "path"), "path", "left_semi"
    )
    ends = _pairs(triples, "hasDependentAsset", "edge", "dependent").join(
        _pairs(triples, "hasDependencyAsset", "edge", "dependency"), "edge"
    )
    edges = steps.join(ends, "edge").select("path", "dependent", "dependency").distinct()
    # The incident is a source once, however many paths hold the edge: beside the smallest of them.
    smallest = edges.groupBy("dependent", "dependency").agg(F.min("path").alias("_first"))
    return edges.join(smallest, ["dependent", "dependency"]).withColumn("_first", F.col("path") == F.col("_first"))


def _path_findings(rows: DataFrame, kind: str, finding_type: str, text: Column) -> DataFrame:
    sources = [F.when(F.col("_first"), F.col("incident")), F.col("path")]
    columns = [_finding(kind, "incident").alias("finding"), F.lit(finding_type).alias("finding_type"), text.alias("text")]
    return explode_present(rows, sources, "derived_from", *columns)


def dependency_exposure(triples: DataFrame, types: DataFrame) -> DataFrame:
    rows = _incident_assets(triples, types).join(
        _path_edges(triples, types).withColumnRenamed("dependent", "asset"), "asset"
    )
    text = F.concat(F.lit("Dependency exposure from "), "asset", F.lit(" through "), "dependency")
    return _path_findings(rows, "dependency-exposure", "DependencyImpactFinding", text)


def blast_radius(triples: DataFrame, types: DataFrame) -> DataFrame:
    """One hop: the assets that depend on the incident's asset."""
    rows = _incident_assets(triples, types).join(
        _path_edges(triples, types).withColumnRenamed("dependency", "asset"), "asset"
    )
    text = F.concat(F.lit("Blast radius placeholder from "), "asset", F.lit(" to "), "dependent")
    return _path_findings(rows, "blast-radius", "BlastRadiusFinding", text)


def _incident_stages(triples: DataFrame, types: DataFrame) -> DataFrame:
    return _pairs(triples, "hasCurrentStage", "incident", "stage").join(
        _members(types, "InfrastructureIncident", "incident"), "incident", "left_semi"
    ).distinct()


def recovery_blocker(triples: DataFrame, types: DataFrame) -> DataFrame:
    """A blocker and a follow-up decision per incident with a stage."""
    rows = _incident_stages(triples, types)
    blocker = _rows(
        rows,
        _finding("recovery-blocker", "incident"),
        "RecoveryBlocker",
        F.concat(F.lit("Current recovery blocker is stage "), "stage"),
        "incident",
    )
    decision = _rows(
        rows.select("incident").distinct(),
        _finding("follow-up-decision", "incident"),
        "FollowUpDecision",
        F.concat(F.lit("Follow up the active blocker for "), "incident"),
        "incident",
    )
    return blocker.unionByName(decision)


def restore_readiness(triples: DataFrame, types: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Restore readiness placeholder for "), "incident", F.lit(" at stage "), "stage")
    rows = _incident_stages(triples, types)
    return _rows(rows, _finding("restore-readiness", "incident"), "RestoreReadinessFinding", text, "incident")


def impact_trust(triples: DataFrame, types: DataFrame) -> DataFrame:
    rows = (
        _pairs(triples, "impactForIncident", "impact", "incident")
        .select("impact")
        .distinct()
        .join(_members(types, "ImpactObservation", "impact"), "impact", "left_semi")
    )
    text = F.concat(F.lit("Impact trust placeholder for "), "impact")
    return _rows(rows, _finding("impact-trust", "impact"), "TrustFinding", text, "impact")


# What the rules read. The domain of each predicate is the class that its rule asks of the subject, so these facts entail it.
RULE_CLASSES = ["InfrastructureIncident", "DependencyPath", "ImpactObservation"]
EDGES = ["hasPathStep", "hasDependentAsset", "hasDependencyAsset"]
RULE_PREDICATES = {
    dependency_exposure: ["affectsAsset", *EDGES],
    blast_radius: ["affectsAsset", *EDGES],
    recovery_blocker: ["hasCurrentStage"],
    restore_readiness: ["hasCurrentStage"],
    impact_trust: ["impactForIncident"],
}


def rule_facts(core: dict[str, DataFrame], *rules: Callable) -> tuple[DataFrame, DataFrame]:
    """Canonical facts that these rules (by default all) read, written once, and the classes that they ask for."""
    asked = {ONTOLOGY + name for rule in rules or RULE_PREDICATES for name in RULE_PREDICATES[rule]}
    triples = checkpoint(canonical_triples(core, only=asked))
    return triples, checkpoint(entailed_types(triples, CONTRACT_SHAPES, RULE_CLASSES))


def all_findings(triples: DataFrame, types: DataFrame) -> DataFrame:
    result = dependency_exposure(triples, types)
    for rule in (blast_radius, recovery_blocker, restore_readiness, impact_trust):
        result = result.unionByName(rule(triples, types))
    return result


def finding_triples(findings: DataFrame, activity: str | None = None, only: str | None = None) -> DataFrame:
    """Findings as triples of the reasoning graph, with the activity's own facts in the provenance graph. Only facts whose
    predicate starts with ``only`` are made, where it is given.

    A fact is told apart by the columns that it is made of, before it becomes one: what hangs on the finding by its rows,
    what the activity used by the sources alone.
    """

    def fact(graph: str, s: Column, p: str, o: Column, kind: str = "iri", datatype: str | None = None) -> Column | None:
        if only is not None and not p.startswith(only):
            return None
        return F.struct(
            F.lit(graph).alias("graph"),
            s.alias("s"),
            F.lit(p).alias("p"),
            o.alias("o"),
            F.lit(kind).alias("o_kind"),
            F.lit(datatype).cast("string").alias("o_datatype"),
        )

    def facts_of(rows: DataFrame, *facts: Column | None) -> DataFrame | None:
        """Facts of rows that are a set."""
        present = [f for f in facts if f is not None]
        return explode_present(rows, present, "f").select("f.*").where("o IS NOT NULL") if present else None

    finding = F.col("finding")
    decision = F.col("finding_type") == "FollowUpDecision"
    said = F.when(decision, ONTOLOGY + "hasRecommendedAction").otherwise(ONTOLOGY + "hasFindingSummary")
    parts = [
        facts_of(
            findings.select("finding", "finding_type").distinct(),
            fact(REASONING, finding, RDF_TYPE, F.concat(F.lit(ONTOLOGY), "finding_type")),
        )
    ]
    if only is None:
        texts = findings.where("finding_type IS NOT NULL AND text IS NOT NULL").select("finding", said.alias("p"), "text").distinct()
        kinds = [F.lit("literal").alias("o_kind"), F.lit(XSD + "string").alias("o_datatype")]
        parts.append(texts.select(F.lit(REASONING).alias("graph"), F.col("finding").alias("s"), "p", F.col("text").alias("o"), *kinds))
    sources = findings.where("derived_from IS NOT NULL")  # a finding may lack its source
    parts.append(
        facts_of(
            sources.select("finding", "derived_from").distinct(),
            fact(REASONING, finding, PROV + "wasDerivedFrom", F.col("derived_from")),
        )
    )
    if activity is not None:
        run = F.lit(activity)
        parts += [
            facts_of(
                findings.select("finding").distinct(),
                fact(REASONING, finding, PROV + "wasGeneratedBy", run),
                fact(PROVENANCE, run, PROV + "generated", finding),
            ),
            facts_of(
                sources.select("derived_from").distinct(), fact(PROVENANCE, run, PROV + "used", F.col("derived_from"))
            ),
            facts_of(findings.limit(1), fact(PROVENANCE, run, RDF_TYPE, F.lit(ONTOLOGY + "ReasoningActivity"))),
        ]
    return reduce(DataFrame.unionByName, [part for part in parts if part is not None])


def finding_lineage(triples: DataFrame) -> DataFrame:
    """Every finding with its type, source facts and the activities that generated it; missing parts are null."""
    reasoning = triples.where(F.col("graph") == REASONING)
    provenance = triples.where(F.col("graph") == PROVENANCE)
    kinds = [ONTOLOGY + name for name in FINDING_TYPES]
    findings = reasoning.where((F.col("p") == RDF_TYPE) & F.col("o").isin(kinds)).select(
        F.col("s").alias("finding"), F.col("o").alias("finding_type")
    )
    sources = reasoning.where(F.col("p") == PROV + "wasDerivedFrom").select(
        F.col("s").alias("finding"), F.col("o").alias("source_fact")
    )
    runs = provenance.where((F.col("p") == RDF_TYPE) & (F.col("o") == ONTOLOGY + "ReasoningActivity")).select("s")
    generated = (
        provenance.where(F.col("p") == PROV + "generated")
        .join(runs, "s", "left_semi")
        .select(F.col("o").alias("finding"), F.col("s").alias("activity"))
    )
    return findings.join(sources, "finding", "left").join(generated, "finding", "left")


def provenance_edges(triples: DataFrame, resource: str | None = None) -> DataFrame:
    edges = triples.where(F.col("p").startswith(PROV))
    if resource is not None:
        edges = edges.where((F.col("s") == resource) | (F.col("o") == resource))
    return edges.select("s", "p", "o")


# --- source to canonical --------------------------------------------------------------------------------


def canonical_triples(
    core: dict[str, DataFrame], base: str = "urn:dcai:canonical:", only: set[str] | None = None
) -> DataFrame:
    """Core rows as facts of the contract vocabulary, each with the source record it came from.

    A stage outside the vocabulary stays a literal, so the shape check rejects it. ``only`` names predicates (in full): no
    other facts are made.
    """
    types = {
        "POWER_PATH": "PowerPath",
        "COOLING_PATH": "CoolingPath",
        "CONTROL_TELEMETRY": "TelemetryPath",
        "REDUNDANCY_SUPPORT": "RedundancyPath",
    }

    def node(kind: str, value: str | Column) -> Column:
        return F.concat(F.lit(f"{base}{kind}:"), encode_for_uri(value))

    def fact(p: str, o: Column, datatype: str | None = None, when: Column | None = None) -> Column | None:
        full = RDF_TYPE if p == "type" else PROV + p[5:] if p.startswith("prov:") else ONTOLOGY + p
        if only is not None and full not in only:
            return None
        made = F.struct(
            F.lit(full).alias("p"),
            o.cast("string").alias("o"),
            F.lit("literal" if datatype else "iri").alias("o_kind"),
            F.lit(XSD + datatype if datatype else None).cast("string").alias("o_datatype"),
        )
        return made if when is None else F.when(when, made)

    def a(name: str, when: Column | None = None) -> Column | None:
        return fact("type", F.lit(ONTOLOGY + name), when=when)

    def build(df: DataFrame, kind: str, key: str, *facts: Column | None, together: bool = True) -> DataFrame | None:
        """The facts of a table, each once. Subjects of two tables differ, so a table is a set for itself. Its rows meet by
        key before they become facts: only facts of keys with several rows have to be told apart. Where few keys have many
        rows, all of them are.
        """
        common = [
            fact("hasIdentifier", F.col(key), "string"),
            fact("prov:wasDerivedFrom", node("source", F.concat(F.lit(f"{kind}/"), key))),
        ]
        present = [f for f in (*facts, *common) if f is not None]
        if not present:
            return None

        def exploded(rows: DataFrame) -> DataFrame:
            return explode_present(rows.withColumn("s", node(kind, key)), present, "f", "s").select("s", "f.*")

        if not together:
            return exploded(df).distinct()
        counted = df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(key)))
        return exploded(counted.where("_rows = 1")).unionByName(exploded(counted.where("_rows > 1")).distinct())

    stage = F.col("current_stage")
    known_stage = F.coalesce(stage.isin(vocab.STAGES), F.lit(False))
    path_type = F.col("dependency_type")
    parts = [
        build(core["zones"], "zone", "zone_id", a("InfrastructureZone")),
        build(
            core["assets"],
            "asset",
            "asset_id",
            a("InfrastructureAsset"),
            fact("locatedIn", node("zone", "zone_id")),
            fact("hasAssetType", F.col("asset_type"), "string"),
            fact("hasCriticalityLevel", F.col("criticality_level"), "string"),
        ),
        build(
            core["incidents"],
            "incident",
            "incident_id",
            a("InfrastructureIncident"),
            fact("affectsAsset", node("asset", "asset_id")),
            fact("hasCurrentStage", node("stage", stage), when=known_stage),
            fact("hasCurrentStage", stage, "string", when=~known_stage),
        ),
        build(
            core["dependencies"],
            "edge",
            "dependency_id",
            a("DependencyEdge"),
            fact("hasDependentAsset", node("asset", "dependent_asset_id")),
            fact("hasDependencyAsset", node("asset", "dependency_asset_id")),
            fact("hasDependencyRole", F.col("dependency_role"), "string"),
        ),
        build(
            core["snapshots"],
            "impact",
            "impact_snapshot_id",
            a("ImpactObservation"),
            fact("impactForIncident", node("incident", "incident_id")),
            fact("estimatedCapacityRiskKw", F.col("estimated_capacity_risk_kw").cast("decimal(18,2)"), "decimal"),
            fact("affectedGpuCount", F.col("affected_gpu_count"), "integer"),
        ),
        build(
            core["alerts"],
            "evidence",
            "telemetry_alert_id",
            a("TelemetryEvidence"),
            fact(
                "supportsFact",
                node("incident", "linked_incident_id"),
                when=F.coalesce(F.col("linked_incident_id") != "", F.lit(False)),
            ),
        ),
    ]
    path_name = F.concat("dependency_type", F.lit("/"), "impact_scope")
    paths = core["dependencies"].where(path_type.isin(list(types))).withColumn("path_id", path_name)
    step = fact("hasPathStep", node("edge", "dependency_id"))
    kinds = [a(class_name, path_type == name) for name, class_name in types.items()]
    parts.append(build(paths, "path", "path_id", *kinds, step, together=False))
    if (a_stage := a("WorkflowStage")) is not None:
        # Told apart as short words, before they become addresses.
        stages = core["incidents"].where(known_stage).select("current_stage").distinct()
        parts.append(stages.select(node("stage", stage).alias("s"), F.explode(F.array(a_stage)).alias("f")).select("s", "f.*"))
    return reduce(DataFrame.unionByName, [part for part in parts if part is not None]).select(F.lit(CANONICAL).alias("graph"), "s", "p", "o", "o_kind", "o_datatype")


def outcomes(candidates: DataFrame, focus_violations: DataFrame) -> DataFrame:
    """Every fact with its ``outcome``, in one join: promoted, or quarantined where its subject has any violation."""
    bad = focus_violations.select(F.col("focus").alias("s"), F.lit("quarantined").alias("outcome")).distinct()
    return candidates.join(bad, "s", "left").withColumn("outcome", F.coalesce("outcome", F.lit("promoted")))


def promote(candidates: DataFrame, focus_violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(promoted, quarantined): facts about a subject with any violation stay out of the canonical graph.

    ``focus_violations`` has a ``focus`` column with full node addresses.
    """
    bad = focus_violations.select(F.col("focus").alias("s")).distinct()
    return candidates.join(bad, "s", "left_anti"), candidates.join(bad, "s", "left_semi")


def promotion_gates(
    findings: DataFrame, canonical_report: DataFrame | bool, known_facts: DataFrame, approvals: DataFrame
) -> DataFrame:
    """One row per finding with a flag per gate; approved when all hold.

    Gates: the canonical graph conforms, the output has a type and text, its sources are facts of the canonical graph
    (else it is stale), provenance is present, there is one text only (else findings conflict), and it was approved.
    ``canonical_report`` is the report, or whether the graph conforms.
    """
    if isinstance(canonical_report, bool):
        conforms = F.lit(canonical_report)
    else:
        conforms = canonical_report.agg((F.count(F.lit(1)) == 0).alias("canonical_conforms")).scalar()
    known = known_facts.select(F.col("s").alias("derived_from"), F.lit(True).alias("_known")).distinct()
    per_finding = (
        findings.join(known, "derived_from", "left")
        .groupBy("finding", "finding_type")
        .agg(
            (F.min("text") == F.max("text")).alias("not_conflicting"),
            (F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0) == 0).alias("shape_valid"),
            (F.count("derived_from") > 0).alias("has_provenance"),
            (F.count_if(F.col("derived_from").isNotNull() & F.col("_known").isNull()) == 0).alias("not_stale"),
        )
    )
    approved = approvals.select("finding", F.lit(True).alias("_approved")).distinct()
    gates = ["canonical_conforms", "shape_valid", "has_provenance", "not_stale", "not_conflicting", "human_approved"]
    flagged = per_finding.join(approved, "finding", "left").select(
        "finding",
        "finding_type",
        conforms.alias("canonical_conforms"),
        F.col("finding_type").isin(FINDING_TYPES).alias("_typed"),
        "shape_valid",
        "has_provenance",
        "not_stale",
        F.coalesce("not_conflicting", F.lit(False)).alias("not_conflicting"),
        F.coalesce("_approved", F.lit(False)).alias("human_approved"),
    )
    flagged = flagged.withColumn("shape_valid", F.col("shape_valid") & F.col("_typed")).drop("_typed")
    every = F.lit(True)
    for gate in gates:
        every = every & F.col(gate)
    return flagged.withColumn("approved", every)


