"""Dependency graph traversal and the triple projection of the core tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalar import explode_present
from faultline.operators import reach
from faultline.operators.workflow import latest_snapshots
from faultline.session import checkpoint

# --- fixed values: namespaces ---
RUNTIME = "https://example.local/ai-data-center-infrastructure#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = RDF + "type"

MAX_PATH_EDGES = 32


def iri(value: str | Column) -> Column:
    """Mint an IRI: trim, then replace every character that is not a letter, digit, _ or - by -."""
    text = F.trim(F.col(value) if isinstance(value, str) else value)
    clean = F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "-")
    return F.concat(F.lit(RUNTIME), F.when(clean == "", "unknown").otherwise(clean))


def local_name(value: str | Column) -> Column:
    """Text after the last #, else after the last /, else all of it."""
    text = F.col(value) if isinstance(value, str) else value
    return F.when(text.contains("#"), F.substring_index(text, "#", -1)).otherwise(F.substring_index(text, "/", -1))


# --- reachability -----------------------------------------------------------------------------------


def downstream_assets(dependencies: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """(origin, asset) for every asset that depends on the origin, directly or not; the origin itself is left out.

    ``origins`` (one ``origin`` column) may be one asset or many; by default every asset something depends on. The
    pairs come from doubling (see ``reach``), cycles collapsed for the whole graph.
    """
    edges = downstream_edges(dependencies)
    return reach.closure(edges).node_pairs() if origins is None else reach.reached_from(edges, origins)


def downstream_edges(dependencies: DataFrame) -> DataFrame:
    """(up, down): from an asset to one that depends on it."""
    return dependencies.select(F.col("dependency_asset_id").alias("up"), F.col("dependent_asset_id").alias("down"))


def blast_radius_counts(dependencies: DataFrame, incidents: DataFrame) -> DataFrame:
    """For every asset that something depends on: how many assets are downstream, and how many incidents they and it have.

    Incidents are counted per asset and assets per component before any pair is made."""
    per_asset = incidents.groupBy(F.col("asset_id").alias("node")).agg(F.count(F.lit(1)).alias("weight"))
    found = reach.closure(downstream_edges(dependencies)).sums({"affected_incidents": per_asset})
    return found.withColumnRenamed("nodes", "downstream_assets")


def affected_incidents(incidents: DataFrame, reach: DataFrame, origins: DataFrame) -> DataFrame:
    """Incidents of any status on an origin or on something downstream of it."""
    covered = reach.unionByName(origins.select("origin", F.col("origin").alias("asset")))
    return covered.join(
        incidents.select("incident_id", F.col("asset_id").alias("asset"), "request_title", "current_stage"), "asset"
    ).select(
        "origin",
        "incident_id",
        F.col("asset").alias("asset_id"),
        F.col("request_title").alias("title"),
        F.col("current_stage").alias("stage"),
    )


def direct_dependencies(dependencies: DataFrame) -> DataFrame:
    """For every asset the edges that touch it, from either end."""
    ends = F.explode(F.array_distinct(F.array("dependent_asset_id", "dependency_asset_id")))
    return dependencies.select(
        ends.alias("asset_id"),
        "dependency_id",
        "dependent_asset_id",
        "dependency_asset_id",
        "dependency_type",
        "dependency_role",
    )


def named_paths(paths: DataFrame, topology: DataFrame) -> DataFrame:
    """Given edge lists (path_id, label, dependency_ids) as node lists with the path's active incidents.

    Edges missing from the topology are skipped; a path without any edge gives no row. A path is as long as the edge
    list it was given, so its node list is bounded by that input row.
    """
    steps = paths.select("path_id", "label", F.posexplode("dependency_ids").alias("step", "dependency_id"))
    edges = steps.join(
        topology.select(
            "dependency_id",
            "dependent_asset_id",
            "dependency_asset_id",
            "dependent_active_incident_count",
            "dependency_active_incident_count",
        ),
        "dependency_id",
    )
    first = F.min_by(
        F.struct(F.col("dependent_asset_id").alias("asset"), F.col("dependent_active_incident_count").alias("n")),
        "step",
    )
    rest = F.sort_array(
        F.collect_list(
            F.struct(
                "step",
                F.col("dependency_asset_id").alias("asset"),
                F.col("dependency_active_incident_count").alias("n"),
            )
        )
    )
    grouped = edges.groupBy("path_id", "label").agg(first.alias("head"), rest.alias("rest"))
    return grouped.select(
        "path_id",
        "label",
        F.concat(F.array("head.asset"), F.col("rest.asset")).alias("nodes"),
        (F.col("head.n") + F.aggregate("rest.n", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias(
            "active_incident_count"
        ),
    )


def enumerated_paths(
    dependencies: DataFrame, incidents_per_asset: DataFrame, max_edges: int = MAX_PATH_EDGES
) -> DataFrame:
    """Every path from an asset that nothing depends on, along what each asset depends on, to its end.

    A path ends at an asset that depends on nothing (``root``), before an asset it already holds (``cycle``; the closing
    edge is its last), or at ``max_edges`` edges with more to come (``limit``). Paths over parallel edges are paths of
    their own; an edge from an asset to itself is none. ``incidents_per_asset`` (asset, n) is added up along the way, so no
    path is taken apart again. Each round extends all open paths by one edge and writes them; ended ones leave the loop.
    """
    counts = incidents_per_asset.select(F.col("asset").alias("_asset"), F.col("n").alias("_n"))
    edges = dependencies.where("dependent_asset_id <> dependency_asset_id").select(
        F.col("dependent_asset_id").alias("from"), F.col("dependency_asset_id").alias("to"), "dependency_id"
    )
    edges = checkpoint(edges.join(counts, F.col("to") == F.col("_asset"), "left").select(
        "from", "to", "dependency_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n")
    ))
    starts = edges.select("from").distinct().join(edges.select("to"), F.col("from") == F.col("to"), "left_anti")
    open_paths = starts.join(counts, F.col("from") == F.col("_asset"), "left").select(
        F.array("from").alias("nodes"),
        F.array().cast("array<string>").alias("dependency_ids"),
        F.col("from").alias("last"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("active_incident_count"),
    )
    ended = []
    for _ in range(max_edges):
        stepped = open_paths.join(edges, F.col("last") == F.col("from"), "left")
        closing = F.array_contains("nodes", F.col("to"))
        longer = F.when(F.col("to").isNull() | closing, F.col("nodes")).otherwise(F.array_append("nodes", F.col("to")))
        ids = F.when(F.col("to").isNull(), F.col("dependency_ids")).otherwise(
            F.array_append("dependency_ids", F.col("dependency_id"))
        )
        stepped = checkpoint(
            stepped.select(
                longer.alias("nodes"),
                ids.alias("dependency_ids"),
                F.col("to").alias("last"),
                (F.col("active_incident_count") + F.when(closing, 0).otherwise(F.coalesce("n", F.lit(0)))).alias(
                    "active_incident_count"
                ),
                F.when(F.col("to").isNull(), "root").when(closing, "cycle").alias("ended"),
            )
        )
        ended.append(stepped.where("ended IS NOT NULL"))
        open_paths = stepped.where("ended IS NULL").drop("ended")
        if not open_paths.head(1):
            break
    onward = edges.select(F.col("from").alias("last")).distinct().withColumn("_more", F.lit(True))
    rest = open_paths.join(onward, "last", "left")
    ended.append(rest.withColumn("ended", F.when(F.col("_more"), "limit").otherwise("root")).drop("_more"))
    return reduce(lambda a, b: a.unionByName(b), ended).select(
        F.element_at("nodes", 1).alias("start_asset_id"),
        F.element_at("nodes", -1).alias("end_asset_id"),
        "nodes",
        "dependency_ids",
        F.size("dependency_ids").alias("length"),
        "ended",
        "active_incident_count",
    )


# --- triples ------------------------------------------------------------------------------------------


def _po(predicate: str, value: Column, kind: str, datatype: str | None) -> Column:
    return F.struct(
        F.lit(predicate).alias("p"),
        value.cast("string").alias("o"),
        F.lit(kind).alias("o_kind"),
        F.lit(datatype).cast("string").alias("o_datatype"),
    )


def _link(name: str, value: str | Column) -> Column:
    return _po(RUNTIME + name, iri(value), "iri", None)


def _text(name: str, value: str | Column, datatype: str = "string") -> Column:
    predicate = name if name.startswith("http") else RUNTIME + name
    return _po(predicate, F.col(value) if isinstance(value, str) else value, "literal", XSD + datatype)


def _a(class_name: str) -> Column:
    return _po(RDF_TYPE, F.lit(RUNTIME + class_name), "iri", None)


def _triples(df: DataFrame, subject: str | Column, *facts: Column) -> DataFrame:
    return explode_present(df, facts, "f", iri(subject).alias("s")).select("s", "f.*")


def core_triples(core: dict[str, DataFrame], issues: DataFrame | None = None) -> DataFrame:
    """Zones, assets, dependencies, incidents, latest snapshots (equal times: smallest id) and all issues of a run.

    Every subject is its own key and every row of a table is one subject, so the parts are sets already; ``distinct`` is
    kept for keys that become equal once cleaned.
    """
    label = RDFS + "label"
    edge_label = F.concat(
        "dependent_asset_id", F.lit(" depends on "), "dependency_asset_id", F.lit(" via "), "dependency_type"
    )
    shown = ["estimated_capacity_risk_kw", "affected_gpu_count", "redundancy_state", "mitigation_status", "vendor_status"]
    snapshots = core["snapshots"].select("incident_id", "impact_snapshot_id", "snapshot_at", *shown)
    latest = latest_snapshots(snapshots, "asc").join(
        core["incidents"].select("incident_id"), "incident_id", "left_semi"
    )
    parts = [
        _triples(
            core["zones"],
            "zone_id",
            _a("Zone"),
            _text(label, "zone_name"),
            _text("zonePriority", "zone_priority"),
            _text("hasCurrentStatus", "current_status"),
        ),
        _triples(
            core["assets"],
            "asset_id",
            _a("Asset"),
            _text(label, "asset_name"),
            _text("assetType", "asset_type"),
            _text("criticalityLevel", "criticality_level"),
            _text("hasCurrentStatus", "current_status"),
            _link("locatedIn", "zone_id"),
        ),
        _triples(
            core["dependencies"],
            "dependency_id",
            _a("Dependency"),
            _text(label, edge_label),
            _link("dependentAsset", "dependent_asset_id"),
            _link("dependsOn", "dependency_asset_id"),
            _link("downstreamAsset", "dependent_asset_id"),
            _link("upstreamAsset", "dependency_asset_id"),
            _text("hasDependencyType", "dependency_type"),
            _text("dependencyRole", "dependency_role"),
            _text("impactScope", "impact_scope"),
        ),
        _triples(
            core["incidents"],
            "incident_id",
            _a("Incident"),
            _text(label, "request_title"),
            _link("affectsAsset", "asset_id"),
            _text("hasCurrentStatus", "current_status"),
            _text("workflowStage", "current_stage"),
            _text("priorityLevel", "priority_level"),
            _text("businessImpact", "business_impact"),
        ),
        _triples(
            latest,
            "impact_snapshot_id",
            _a("ImpactSnapshot"),
            _text("estimatedCapacityRiskKw", F.col("estimated_capacity_risk_kw"), "decimal"),
            _text("affectedGpuCount", "affected_gpu_count", "integer"),
            _text("redundancyState", "redundancy_state"),
            _text("mitigationStatus", "mitigation_status"),
            _text("vendorStatus", "vendor_status"),
        ),
        _triples(latest, "incident_id", _link("hasImpactSnapshot", "impact_snapshot_id")),
    ]
    result = reduce(DataFrame.unionByName, parts).where("o IS NOT NULL").distinct()
    if issues is None:
        return result
    # Issue ids are numbers of a rank, so each of these facts is there once and none of them is shuffled.
    of_issues = [
        _triples(issues, "issue_id", _a("TrustIssue"), _text(label, "message"), _text("confidenceStatus", "severity")),
        _triples(issues.where("incident_id IS NOT NULL"), "incident_id", _link("hasTrustIssue", "issue_id")),
    ]
    return reduce(DataFrame.unionByName, of_issues, result).where("o IS NOT NULL")


def n_triples(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple."""
    text = F.col("o")
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(char), F.lit(escape))
    typed = F.when(
        F.col("o_datatype").isNull() | (F.col("o_datatype") == XSD + "string"), F.concat(F.lit('"'), text, F.lit('"'))
    ).otherwise(F.concat(F.lit('"'), text, F.lit('"^^<'), "o_datatype", F.lit(">")))
    target = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(typed)
    return triples.select(
        F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), target, F.lit(" .")).alias("line")
    )


def incident_evidence(core: dict[str, DataFrame], issues: DataFrame) -> DataFrame:
    """Each incident with the ids of its trust issues in long form; no issue gives one row with a null id."""
    return core["incidents"].select(
        "incident_id",
        "request_title",
        "asset_id",
        F.col("current_stage").alias("workflow_stage"),
        "current_status",
        "priority_level",
    ).join(
        issues.where("incident_id IS NOT NULL").select("incident_id", F.col("issue_id").alias("trust_issue_id")),
        "incident_id",
        "left",
    )
