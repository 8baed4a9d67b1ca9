"""Class entailment and shape constraints over triple tables.

Constraints are rows of a small fixed table. A node's classes and the paths it has values of are bits of whole numbers, so that
facts meet by node once, and one row per node is held against all shapes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.graph import RDF_TYPE, RUNTIME, XSD, local_name
from faultline.session import checkpoint

WORD = 62  # classes or paths in one whole number

# --- fixed values: vocabularies ------------------------------------------------------------------
ONTOLOGY = "urn:dcai:ontology:"
PROV = "http://www.w3.org/ns/prov#"

# class -> parent class
CONTRACT_PARENT = {
    "InfrastructureEntity": "OperationalEntity",
    "OperationalEvent": "OperationalEntity",
    "EvidenceArtifact": "OperationalEntity",
    "DerivedFact": "OperationalEntity",
    "Facility": "InfrastructureEntity",
    "InfrastructureZone": "InfrastructureEntity",
    "InfrastructureAsset": "InfrastructureEntity",
    "ComputeCapacityGroup": "InfrastructureEntity",
    "PowerAsset": "InfrastructureAsset",
    "CoolingAsset": "InfrastructureAsset",
    "ControlTelemetryAsset": "InfrastructureAsset",
    "DependencyEdge": "OperationalEntity",
    "DependencyPath": "OperationalEntity",
    "PowerPath": "DependencyPath",
    "CoolingPath": "DependencyPath",
    "TelemetryPath": "DependencyPath",
    "RedundancyPath": "DependencyPath",
    "InfrastructureIncident": "OperationalEntity",
    "WorkflowEvent": "OperationalEvent",
    "RecoveryBlocker": "DerivedFact",
    "FollowUpDecision": "DerivedFact",
    "ImpactObservation": "EvidenceArtifact",
    "CapacityExposure": "ImpactObservation",
    "GpuExposure": "ImpactObservation",
    "ThermalExposure": "ImpactObservation",
    "RedundancyExposure": "ImpactObservation",
    "VendorExposure": "ImpactObservation",
    "EvidenceRecord": "EvidenceArtifact",
    "SourceQualityIssue": "EvidenceArtifact",
    "TelemetryEvidence": "EvidenceRecord",
    "ValidationEvidence": "EvidenceRecord",
    "WorkOrderEvidence": "EvidenceRecord",
    "TrustFinding": "DerivedFact",
    "FollowUpQueueItem": "DerivedFact",
    "OperationalPriorityScore": "DerivedFact",
    "DependencyImpactFinding": "DerivedFact",
    "RestoreReadinessFinding": "DerivedFact",
    "BlastRadiusFinding": "DerivedFact",
    "AIInteraction": "OperationalEvent",
    "AIQuestion": "AIInteraction",
    "GeneratedSparql": "EvidenceArtifact",
    "ProposedTripleSet": "EvidenceArtifact",
    "AIApprovalDecision": "OperationalEvent",
    "AIGuardrailViolation": "EvidenceArtifact",
}
# property -> class of its subject
CONTRACT_DOMAIN = {
    "hasIdentifier": "OperationalEntity",
    "hasSourceSystem": "OperationalEntity",
    "observedAt": "OperationalEntity",
    "createdAt": "OperationalEntity",
    "locatedIn": "InfrastructureAsset",
    "zoneInFacility": "InfrastructureZone",
    "hasAssetType": "InfrastructureAsset",
    "hasCriticalityLevel": "InfrastructureAsset",
    "hasOperationalStatus": "InfrastructureEntity",
    "dependsOn": "InfrastructureAsset",
    "supports": "InfrastructureAsset",
    "hasDependentAsset": "DependencyEdge",
    "hasDependencyAsset": "DependencyEdge",
    "hasDependencyRole": "DependencyEdge",
    "hasImpactScope": "DependencyEdge",
    "hasPathStep": "DependencyPath",
    "affectsAsset": "InfrastructureIncident",
    "hasCurrentStage": "InfrastructureIncident",
    "enteredStage": "WorkflowEvent",
    "exitedStage": "WorkflowEvent",
    "hasAllowedNextStage": "WorkflowStage",
    "hasRecommendedAction": "FollowUpDecision",
    "impactForIncident": "ImpactObservation",
    "estimatedCapacityRiskKw": "ImpactObservation",
    "affectedGpuCount": "ImpactObservation",
    "hasRedundancyState": "ImpactObservation",
    "hasMitigationState": "ImpactObservation",
    "hasVendorState": "ImpactObservation",
    "supportsFact": "EvidenceRecord",
    "contradictsFact": "EvidenceRecord",
    "hasConfidenceState": "EvidenceArtifact",
    "hasEvidenceSeverity": "EvidenceArtifact",
    "queueItemForIncident": "FollowUpQueueItem",
    "hasPriorityScore": "OperationalPriorityScore",
    "hasPriorityRank": "FollowUpQueueItem",
    "hasFindingSummary": "DerivedFact",
    "hasSourceRecordId": "SourceRecord",
    "hasSourcePayloadHash": "SourceRecord",
    "generatedQuery": "GeneratedSparql",
    "proposesTriple": "ProposedTripleSet",
    "hasApprovalState": "AIApprovalDecision",
    "blockedByGuardrail": "AIInteraction",
    "validatedAgainstShape": "ProposedTripleSet",
}
# property -> class of its object, object properties only
CONTRACT_RANGE = {
    "hasSourceSystem": "SourceSystem",
    "locatedIn": "InfrastructureZone",
    "zoneInFacility": "Facility",
    "dependsOn": "InfrastructureAsset",
    "supports": "InfrastructureAsset",
    "hasDependentAsset": "InfrastructureAsset",
    "hasDependencyAsset": "InfrastructureAsset",
    "hasPathStep": "DependencyEdge",
    "affectsAsset": "InfrastructureAsset",
    "hasCurrentStage": "WorkflowStage",
    "enteredStage": "WorkflowStage",
    "exitedStage": "WorkflowStage",
    "hasAllowedNextStage": "WorkflowStage",
    "impactForIncident": "InfrastructureIncident",
    "supportsFact": "OperationalEntity",
    "contradictsFact": "OperationalEntity",
    "queueItemForIncident": "InfrastructureIncident",
    "blockedByGuardrail": "AIGuardrailViolation",
}
RUNTIME_DOMAIN = {
    "locatedIn": "Asset",
    "affectsAsset": "Incident",
    "hasImpactSnapshot": "Incident",
    "hasTrustIssue": "Incident",
}
RUNTIME_RANGE = {
    "locatedIn": "Zone",
    "affectsAsset": "Asset",
    "hasImpactSnapshot": "ImpactSnapshot",
    "hasTrustIssue": "TrustIssue",
}

# (target class, path, least, most, datatype, class of value)
RUNTIME_CONSTRAINTS = [
    ("Asset", "locatedIn", 1, 1, None, None),
    ("Asset", "assetType", 1, None, "string", None),
    ("Asset", "hasCurrentStatus", 1, None, "string", None),
    ("Incident", "affectsAsset", 1, 1, None, None),
    ("Incident", "workflowStage", 1, None, "string", None),
    ("Incident", "priorityLevel", 1, None, "string", None),
    ("Dependency", "dependentAsset", 1, 1, None, None),
    ("Dependency", "dependsOn", 1, 1, None, None),
    ("Dependency", "hasDependencyType", 1, None, "string", None),
    ("Dependency", "dependencyRole", 1, None, "string", None),
]
CONTRACT_CONSTRAINTS = [
    ("InfrastructureAsset", "hasIdentifier", 1, None, "string", None),
    ("InfrastructureAsset", "locatedIn", 1, None, None, "InfrastructureZone"),
    ("InfrastructureIncident", "affectsAsset", 1, 1, None, "InfrastructureAsset"),
    ("InfrastructureIncident", "hasCurrentStage", 1, 1, None, "WorkflowStage"),
    ("DependencyEdge", "hasDependentAsset", 1, 1, None, "InfrastructureAsset"),
    ("DependencyEdge", "hasDependencyAsset", 1, 1, None, "InfrastructureAsset"),
    ("DependencyEdge", "hasDependencyRole", 1, None, "string", None),
    ("ImpactObservation", "impactForIncident", 1, 1, None, "InfrastructureIncident"),
    ("ImpactObservation", "estimatedCapacityRiskKw", 0, None, "decimal", None),
    ("ImpactObservation", "affectedGpuCount", 0, None, "integer", None),
    ("DerivedFact", "prov:wasGeneratedBy", 1, None, None, None),
    ("SourceRecord", "hasSourceRecordId", 1, None, "string", None),
    ("SourceRecord", "hasSourceSystem", 1, None, None, None),
    ("ProposedTripleSet", "proposesTriple", 1, None, "string", None),
    ("ProposedTripleSet", "validatedAgainstShape", 1, None, "anyURI", None),
    ("ProposedTripleSet", "prov:wasGeneratedBy", 1, None, None, None),
    ("ReasoningActivity", "prov:used", 1, None, None, None),
    ("ReasoningActivity", "prov:generated", 1, None, None, None),
    ("ReasoningActivity", "prov:generatedAtTime", 1, None, "dateTime", None),
    ("FollowUpDecision", "hasRecommendedAction", 1, None, "string", None),
    ("FollowUpDecision", "prov:wasDerivedFrom", 1, None, None, None),
    ("FollowUpDecision", "prov:wasGeneratedBy", 1, None, None, "ReasoningActivity"),
] + [
    (finding, *rest)
    for finding in (
        "DependencyImpactFinding",
        "RecoveryBlocker",
        "RestoreReadinessFinding",
        "TrustFinding",
        "BlastRadiusFinding",
    )
    for rest in (
        ("hasFindingSummary", 1, None, "string", None),
        ("prov:wasDerivedFrom", 1, None, None, None),
        ("prov:wasGeneratedBy", 1, None, None, "ReasoningActivity"),
    )
]
# target class -> alternatives (path, class of value): at least one must hold
CONTRACT_ALTERNATIVES = {
    "WorkflowEvent": [("enteredStage", "WorkflowStage"), ("exitedStage", "WorkflowStage")],
    "EvidenceRecord": [("supportsFact", None), ("contradictsFact", None)],
    "OperationalEntity": [("prov:wasDerivedFrom", None), ("prov:wasGeneratedBy", None)],
}


class ShapeSet:
    """A vocabulary with its entailment rules and constraints."""

    def __init__(self, namespace, parent, domain, range_, constraints, alternatives):
        self.namespace = namespace
        self.constraints = constraints
        self.alternatives = alternatives
        self.parent = parent
        classes = {*parent, *parent.values(), *domain.values(), *range_.values(), *(c[0] for c in constraints)}
        self.closure = {self.full(c): self._ancestors(c) for c in sorted(classes)}
        self.domain = {self.full(p): self._ancestors(c) for p, c in domain.items()}
        self.range = {self.full(p): self._ancestors(c) for p, c in range_.items()}

    def full(self, name: str) -> str:
        return PROV + name[5:] if name.startswith("prov:") else self.namespace + name

    def asked_classes(self) -> set[str]:
        """Classes that some constraint names."""
        names = {c for target, *_, value_class in self.constraints for c in (target, value_class) if c}
        for target, options in self.alternatives.items():
            names |= {target, *(value_class for _, value_class in options if value_class)}
        return {self.full(name) for name in names}

    def asked_paths(self) -> set[str]:
        """Paths whose values are counted, or are a choice by being there."""
        names = {path for _, path, least, most, *_ in self.constraints if least > 0 or most is not None}
        return {self.full(name) for name in names | {path for o in self.alternatives.values() for path, _ in o}}

    def counted_paths(self) -> list[str]:
        """Paths for which it is not enough to know whether there is a value."""
        return sorted({self.full(path) for _, path, least, most, *_ in self.constraints if least > 1 or most is not None})

    def _ancestors(self, name: str) -> list[str]:
        chain = [name]
        while chain[-1] in self.parent:
            chain.append(self.parent[chain[-1]])
        return [self.full(c) for c in chain]


RUNTIME_SHAPES = ShapeSet(RUNTIME, {}, RUNTIME_DOMAIN, RUNTIME_RANGE, RUNTIME_CONSTRAINTS, {})
CONTRACT_SHAPES = ShapeSet(
    ONTOLOGY, CONTRACT_PARENT, CONTRACT_DOMAIN, CONTRACT_RANGE, CONTRACT_CONSTRAINTS, CONTRACT_ALTERNATIVES
)


def _bits(classes) -> dict[str, tuple[int, int]]:
    """class -> (word, bit): sets of classes are whole numbers, so a node's classes are one row."""
    return {name: (i // WORD, 1 << i % WORD) for i, name in enumerate(sorted(classes))}


def _masks(triples: DataFrame, shapes: ShapeSet, bits: dict[str, tuple[int, int]], domains: bool = True) -> list[DataFrame]:
    """Rows (node, m0, m1, ...) from stated types, domains and ranges."""
    words = _words(bits)

    def table(classes: dict[str, list[str]], key: str) -> DataFrame:
        """The fixed rules of a vocabulary, below two hundred rows, so broadcasting them is bounded."""
        rows = []
        for name, chain in classes.items():
            if any(sums := _sums(chain, bits)):
                rows.append((name, *sums))
        schema = ", ".join([f"{key} STRING", *[f"{word} BIGINT" for word in words]])
        return F.broadcast(triples.sparkSession.createDataFrame(rows, schema))

    stated = triples.where(F.col("p") == RDF_TYPE).join(table(shapes.closure, "o"), "o")
    parts = [stated.select(F.col("s").alias("node"), *words)]
    if domains and shapes.domain:
        of_subject = triples.where(F.col("p") != RDF_TYPE).join(table(shapes.domain, "p"), "p")
        parts.append(of_subject.select(F.col("s").alias("node"), *words))
    if shapes.range:
        of_object = triples.where(F.col("o_kind") == "iri").join(table(shapes.range, "p"), "p")
        parts.append(of_object.select(F.col("o").alias("node"), *words))
    return parts


def _sums(names, bits: dict[str, tuple[int, int]]) -> list[int]:
    """The words that hold these classes; names without a bit are left out."""
    return [sum(bits[n][1] for n in set(names) if n in bits and f"m{bits[n][0]}" == w) for w in _words(bits)]


def _words(bits: dict[str, tuple[int, int]]) -> list[str]:
    return [f"m{w}" for w in sorted({word for word, _ in bits.values()})]


def entailed_types(triples: DataFrame, shapes: ShapeSet, only: list[str] | None = None) -> DataFrame:
    """(node, class) from stated types, domains and ranges, closed over subclasses. Literals get no type.

    ``only`` names the classes asked for; facts that entail none of them are not looked at.
    """
    asked = set(shapes.closure) if only is None else {shapes.full(name) for name in only}
    bits = _bits(asked)
    words = _words(bits)
    sets = reduce(DataFrame.unionByName, _masks(triples, shapes, bits))
    sets = sets.groupBy("node").agg(*[F.bit_or(word).alias(word) for word in words])
    rows = [(name, *[bit if w == word else 0 for w in range(len(words))]) for name, (word, bit) in bits.items()]
    schema = ", ".join(["class STRING", *[f"b{w} BIGINT" for w in range(len(words))]])
    classes = F.broadcast(triples.sparkSession.createDataFrame(rows, schema))  # some fifty rows
    holds = reduce(lambda x, y: x | y, [F.col(f"m{w}").bitwiseAND(F.col(f"b{w}")) != 0 for w in range(len(words))])
    known = sets.join(classes, holds).select("node", "class")
    if only is not None:
        return known
    other = triples.where((F.col("p") == RDF_TYPE) & ~F.coalesce(F.col("o").isin(list(bits)), F.lit(False)))
    return known.unionByName(other.select(F.col("s").alias("node"), F.col("o").alias("class")).distinct())


def _violation_kinds(
    triples: DataFrame, shapes: ShapeSet, types: DataFrame | None, unique: bool
) -> list[DataFrame]:
    triples = triples.select("s", "p", "o", "o_kind", "o_datatype")
    triples = triples if unique else triples.distinct()
    bits = _bits(shapes.asked_classes())
    nodes = checkpoint(_nodes(triples, shapes, types, bits))
    kinds = [_value_violations(triples, nodes, shapes, bits), _count_violations(nodes, shapes, bits)]
    choices = [(target, options) for target, options in shapes.alternatives.items() if any(c for _, c in options)]
    return kinds + [_choice_violations(triples, nodes, shapes, bits, target, options) for target, options in choices]


def _has_class(bits: dict[str, tuple[int, int]], name: str) -> Column:
    word, bit = bits[name]
    return F.col(f"m{word}").bitwiseAND(F.lit(bit)) != 0


def _nodes(triples: DataFrame, shapes: ShapeSet, types: DataFrame | None, bits: dict[str, tuple[int, int]]) -> DataFrame:
    """One row per node: the classes some constraint names (``m0``..), the paths it has values of (``h0``..) and, for paths
    with other bounds than "at least one", how many (``n``). Subject and object side meet in one shuffle."""
    words, paths = _words(bits), _bits(shapes.asked_paths())
    held = [name.replace("m", "h") for name in _words(paths)]
    counted = shapes.counted_paths()
    numbers = [f"n{k}" for k in range(len(counted))]

    def table(key: str, rows: list[tuple], columns: list[str]) -> DataFrame:
        """Fixed rules of a vocabulary, below two hundred rows."""
        schema = ", ".join([f"{key} STRING", *[f"{name} BIGINT" for name in columns]])
        return F.broadcast(triples.sparkSession.createDataFrame(rows, schema))

    domain = {} if types is not None else shapes.domain
    if types is None:
        parts = _masks(triples, shapes, bits, domains=False)
    else:
        of_class = table("class", [(name, *_sums([name], bits)) for name in bits], words)
        parts = [types.join(of_class, "class").select("node", *words)]
    nothing = [F.lit(0).cast("bigint").alias(name) for name in [*held, *numbers]]
    parts = [part.select("node", *words, *nothing) for part in parts]
    # What a predicate says of its subject: its class, and that there is a value.
    says = [
        (p, *_sums(domain.get(p, []), bits), *_sums([p], paths), *[int(p == c) for c in counted])
        for p in sorted({*domain, *paths} - {RDF_TYPE})
    ]
    of_subject = triples.select("s", "p").join(table("p", [row for row in says if any(row[1:])], [*words, *held, *numbers]), "p")
    parts.append(of_subject.select(F.col("s").alias("node"), *words, *held, *numbers))
    return reduce(DataFrame.unionByName, parts).groupBy("node").agg(
        *[F.bit_or(name).alias(name) for name in [*words, *held]], *[F.sum(name).alias(name) for name in numbers]
    ).where(reduce(lambda x, y: x | y, [F.col(word) != 0 for word in words]))


def _violations(triples: DataFrame, shapes: ShapeSet, types: DataFrame | None, unique: bool) -> DataFrame:
    return reduce(DataFrame.unionByName, _violation_kinds(triples, shapes, types, unique))


def conforms(triples: DataFrame, shapes: ShapeSet, types: DataFrame | None = None, unique: bool = False) -> bool:
    """Whether the report has no row. Kinds of constraints are asked one after the other, up to the first with a violation;
    a graph that conforms is asked for all of them."""
    return all(kind.isEmpty() for kind in _violation_kinds(triples, shapes, types, unique))


def validation_report(
    triples: DataFrame, shapes: ShapeSet, types: DataFrame | None = None, unique: bool = False
) -> DataFrame:
    """Violations (focus_node, result_path, component, value, message, severity); no row means it conforms.

    Counting gives one row per focus and path, datatype and class one row per bad value, an unmet choice one row per
    focus with a null path. ``unique`` says that the triples are a set already, graphs left aside.
    """
    return _violations(triples, shapes, types, unique).select(
        local_name("focus").alias("focus_node"),
        local_name("path").alias("result_path"),
        "component",
        "value",
        "message",
        F.lit("Violation").alias("severity"),
    )


def violating_subjects(
    triples: DataFrame, shapes: ShapeSet, types: DataFrame | None = None, unique: bool = False
) -> DataFrame:
    """Full addresses of the nodes with any violation, as ``focus``."""
    return _violations(triples, shapes, types, unique).select("focus").distinct()


def report_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("issue_count")).select(
        (F.col("issue_count") == 0).alias("conforms"), "issue_count"
    )


def _count_violations(nodes: DataFrame, shapes: ShapeSet, bits: dict[str, tuple[int, int]]) -> DataFrame:
    """Too few or too many values of a path, and choices of which none is met. A node is held against the fixed rules, some
    forty rows; of several rules of one path the strictest counts."""
    words, paths = _words(bits), _bits(shapes.asked_paths())
    held = [name.replace("m", "h") for name in _words(paths)]
    counted = shapes.counted_paths()

    rows = []
    rules = [(shapes.full(target), shapes.full(path), least, most) for target, path, least, most, *_ in shapes.constraints]
    for i, (target, path, least, most) in enumerate(rules):
        same = [(k, *rule) for k, rule in enumerate(rules) if rule[1] == path]
        slot = counted.index(path) if path in counted else None
        if least > 0:
            stricter = [t for k, t, _, n, _ in same if n > least or (n == least and k < i)]
            few = f"fewer than {least} values"
            asked = _sums([path] if slot is None else [], paths)
            rows.append((path, "minCount", few, slot, least, None, *_sums([target], bits), *_sums(stricter, bits), *asked))
        if most is not None:
            stricter = [t for k, t, _, _, n in same if n is not None and (n < most or (n == most and k < i))]
            many = f"more than {most} values"
            nothing = _sums([], paths)
            rows.append((path, "maxCount", many, slot, None, most, *_sums([target], bits), *_sums(stricter, bits), *nothing))
    for target, options in shapes.alternatives.items():
        if not any(value_class for _, value_class in options):
            names = [path for path, _ in options]
            asked = _sums([shapes.full(path) for path in names], paths)
            text = f"needs {' or '.join(names)}"
            rows.append((None, "or", text, None, None, None, *_sums([shapes.full(target)], bits), *_sums([], bits), *asked))
    count = range(len(words))
    schema = "path STRING, component STRING, message STRING, slot INT, least BIGINT, most BIGINT, " + ", ".join(
        [f"t{w} BIGINT" for w in count] + [f"x{w} BIGINT" for w in count] + [f"a{w} BIGINT" for w in range(len(held))]
    )
    table = F.broadcast(nodes.sparkSession.createDataFrame(rows, schema))

    def common(left: list[str], right: str) -> Column:
        tests = [F.col(name).bitwiseAND(F.col(f"{right}{k}")) != 0 for k, name in enumerate(left)]
        return reduce(lambda x, y: x | y, tests)

    applies = common(words, "t") & ~common(words, "x")
    broken = F.col("slot").isNull() & ~common(held, "a")
    for k in range(len(counted)):
        n = F.col(f"n{k}")
        broken = broken | ((F.col("slot") == k) & ((n < F.col("least")) | (n > F.col("most"))))
    found = nodes.join(table, applies & broken)
    return found.select(F.col("node").alias("focus"), "path", "component", F.lit(None).cast("string").alias("value"), "message")


def _local(name: str) -> str:
    """``local_name`` of a fixed name."""
    return name.split("#")[-1] if "#" in name else name.split("/")[-1]


def _value_violations(
    triples: DataFrame, nodes: DataFrame, shapes: ShapeSet, bits: dict[str, tuple[int, int]]
) -> DataFrame:
    """Values of a wrong datatype or class. The bad ones of both kinds ask for the class of their subject in one join."""
    words = _words(bits)
    rows = []
    for i, (target, path, _, _, datatype, value_class) in enumerate(shapes.constraints):
        if datatype or value_class:
            of = lambda name: [bits[shapes.full(name)][1] if name and bits[shapes.full(name)][0] == w else 0 for w in range(len(words))]
            text = f"value is not of type {datatype}" if datatype else f"value is not a {_local(shapes.full(value_class))}"
            kind = "datatype" if datatype else "class"
            rows.append((i, shapes.full(path), kind, XSD + datatype if datatype else None, text, *of(target), *of(value_class)))
    count = range(len(words))
    schema = "rule INT, path STRING, component STRING, datatype STRING, message STRING, " + ", ".join(
        [f"t{w} BIGINT" for w in count] + [f"v{w} BIGINT" for w in count]
    )
    table = triples.sparkSession.createDataFrame(rows, schema)  # some fifty rows
    by_datatype, by_class = [F.broadcast(table.where(F.col("component") == kind)) for kind in ("datatype", "class")]

    def common(name: str) -> Column:
        return reduce(lambda x, y: x | y, [F.col(f"m{w}").bitwiseAND(F.col(f"{name}{w}")) != 0 for w in count])

    kept = ["s", "path", "component", "o", "message", *[f"t{w}" for w in count]]
    good = (F.col("o_kind") == "literal") & F.col("o_datatype").eqNullSafe(F.col("datatype"))
    bad = [triples.join(by_datatype, F.col("p") == F.col("path")).where(~good).select(*kept)]
    if any(value_class for *_, value_class in shapes.constraints):
        values = triples.join(by_class, F.col("p") == F.col("path"))
        # Each object is asked for once, however many values it stands in; only the bad ones meet their values again.
        asked = ["rule", "o", "o_kind"]
        typed = (F.col("o_kind") == "iri") & (F.col("o") == F.col("node")) & common("v")
        once = values.select(*asked, *[f"v{w}" for w in count]).distinct()
        wrong = checkpoint(once.join(nodes.select("node", *words), typed, "left_anti").select(*asked))
        bad.append(values.join(wrong, asked, "left_semi").select(*kept))
    hit = reduce(DataFrame.unionByName, bad).join(
        nodes.select("node", *words), (F.col("s") == F.col("node")) & common("t"), "left_semi"
    )
    return hit.select(F.col("s").alias("focus"), "path", "component", F.col("o").alias("value"), "message")


def _choice_violations(
    triples: DataFrame, nodes: DataFrame, shapes: ShapeSet, bits: dict[str, tuple[int, int]], target: str, options: list
) -> DataFrame:
    """Choices in which a value's class matters."""
    met = None
    for path, value_class in options:
        values = triples.where(F.col("p") == shapes.full(path)).select(F.col("s").alias("focus"), "o", "o_kind")
        if value_class:
            wanted = nodes.where(_has_class(bits, shapes.full(value_class))).select(F.col("node").alias("o"))
            typed = values.join(wanted.withColumn("_ok", F.lit(True)), "o", "left")
            holds = typed.groupBy("focus").agg(
                F.min(F.coalesce("_ok", F.lit(False)) & (F.col("o_kind") == "iri")).alias("_all")
            )
            option = holds.where("_all").select("focus")
        else:
            option = values.select("focus").distinct()
        met = option if met is None else met.unionByName(option)
    targets = nodes.where(_has_class(bits, shapes.full(target))).select(F.col("node").alias("focus"))
    nothing = F.lit(None).cast("string")
    return targets.join(met, "focus", "left_anti").select(
        "focus", nothing.alias("path"), F.lit("or").alias("component"), nothing.alias("value"),
        F.lit(f"needs {' or '.join(path for path, _ in options)}").alias("message"),
    )
