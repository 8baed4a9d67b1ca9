"""Raw payloads and master extracts to typed core tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions.scalar import col, parse_iso, truthy
from faultline.operators.skew import spread_nulls
from faultline.sources.contracts import FEED_BY_CORE, Feed

READINGS = f"ARRAY<{schemas.READING}>"


def payload_fields(records: DataFrame, feed: Feed) -> DataFrame:
    """Adds every payload field as text in a ``p_`` column; null where the payload is not an object.

    ``json_tuple`` parses a payload once, however many fields are used later. Numbers, booleans and nested JSON keep
    their JSON text.
    """
    return records.select("*", F.json_tuple("payload", *feed.fields).alias(*[f"p_{name}" for name in feed.fields]))


def missing_fields(feed: Feed) -> Column:
    """Names of required fields that are null or empty, sorted and joined by commas; empty where none is missing."""
    names = sorted(feed.required)
    return F.concat_ws(",", *[F.when(~truthy(f"p_{name}"), F.lit(name)) for name in names])


def has_required(feed: Feed) -> Column:
    # One compiled predicate: a chain of fourteen conjuncts makes the optimizer infer constraints for minutes.
    return F.least(*[truthy(f"p_{name}") for name in feed.required])


def _typed(name: str, type_name: str, source: str) -> Column:
    value = col(source)
    if type_name == "TIMESTAMP_NTZ":
        return parse_iso(F.nullif(value, F.lit(""))).alias(name)
    if type_name.startswith("ARRAY"):
        return F.from_json(value, READINGS).alias(name)
    if type_name == "INT":
        return value.cast("double").cast("int").alias(name)
    return value.cast(type_name.lower()).alias(name)


def typed_columns(table: str, prefix: str = "") -> list[Column]:
    """Cast every field of a core table; a bad value raises and so fails the run."""
    result = []
    for name, type_name in _name_types(schemas.CORE[table]):
        source = "telemetry_readings_json" if name == "telemetry_readings" else name
        result.append(_typed(name, type_name, prefix + source))
    return result


def _name_types(ddl: str) -> list[tuple[str, str]]:
    names = schemas.column_names(ddl)
    cut = [ddl.index(f"{name} ") if i == 0 else ddl.index(f", {name} ") + 2 for i, name in enumerate(names)]
    ends = [start - 2 for start in cut[1:]] + [len(ddl)]
    return [(n, ddl[s + len(n) + 1 : e].strip()) for n, s, e in zip(names, cut, ends, strict=True)]


def keep_known(rows: DataFrame, column: str, known: DataFrame, key: str, optional: bool = False) -> DataFrame:
    """Rows whose reference exists. An optional reference is only checked when it is filled in."""
    ids = known.select(F.col(key).alias("_id")).distinct()
    if not optional:
        return rows.join(ids, F.col(column) == F.col("_id"), "left_semi")
    filled = F.nullif(F.col(column), F.lit(""))
    key = spread_nulls(filled, *rows.columns)
    return rows.join(ids, key == F.col("_id"), "left").where(filled.isNull() | F.col("_id").isNotNull()).drop("_id")


def upsert(stored: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Merge by primary key: the last new row of a key in feed order wins over earlier ones and over the stored row."""
    columns = [name for name in new.columns if name != "position"]
    last = new.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), "position").alias("_row"))
    latest = last.select("_row.*")
    if stored is None:
        return latest
    return stored.join(latest.select(key), key, "left_anti").select(*columns).unionByName(latest)


def accepted_masters(masters: dict[str, DataFrame], stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Typed master rows. Dependencies keep only edges between known assets."""
    rows = {name: df.select(*typed_columns(name), "position") for name, df in masters.items()}
    assets = rows["assets"].select("asset_id")
    if "assets" in stored:
        assets = assets.unionByName(stored["assets"].select("asset_id"))
    for column in ("dependent_asset_id", "dependency_asset_id"):
        rows["dependencies"] = keep_known(rows["dependencies"], column, assets, "asset_id")
    return rows


def accepted_payloads(table: str, raw: DataFrame, core: dict[str, DataFrame]) -> DataFrame:
    """Typed rows of one raw feed that have their required fields and resolve their references in ``core``."""
    feed = FEED_BY_CORE[table]
    parsed = payload_fields(raw, feed).where(has_required(feed))
    references = {
        "incidents": [("asset_id", "assets", False), ("zone_id", "zones", False)],
        "events": [("incident_id", "incidents", False)],
        "work_orders": [
            ("incident_id", "incidents", False),
            ("assigned_engineer_id", "engineers", True),
            ("required_spare_id", "spares", True),
        ],
        "validations": [("incident_id", "incidents", False), ("validator_id", "engineers", True)],
        "alerts": [("asset_id", "assets", False), ("linked_incident_id", "incidents", True)],
    }[table]
    rows = parsed.select("position", *[F.col(f"p_{name}").alias(name) for name in feed.fields])
    for column, target, optional in references:
        rows = keep_known(rows, column, core[target], schemas.PRIMARY_KEY[target], optional)
    return rows.select(*typed_columns(table), "position")


def accepted_snapshots(rows: DataFrame, core: dict[str, DataFrame]) -> DataFrame:
    for column, target in (("incident_id", "incidents"), ("asset_id", "assets"), ("zone_id", "zones")):
        rows = keep_known(rows, column, core[target], schemas.PRIMARY_KEY[target])
    return rows.select(*typed_columns("snapshots"), "position")
