"""Raw load with duplicate rejection, the same inside one file and across runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalar import truthy

KEY = ["source_system", "source_record_id"]


def has_object_payload() -> Column:
    return F.coalesce(F.ltrim("payload").startswith("{"), F.lit(False))


def is_loadable() -> Column:
    return truthy("source_system") & truthy("source_record_id") & has_object_payload()


def split_duplicates(records: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected): the first record of each key in feed order is loaded unless the key is already stored.

    Copies are reduced to their first position map-side, so a key that holds a third of a feed is one row per task
    before the shuffle.
    """
    usable = records.where(is_loadable())
    # Two aggregates: where only places and counts are asked for, no payload is sorted or shuffled.
    first = usable.groupBy(*KEY).agg(
        F.min_by("payload", "position").alias("payload"),
        F.min("position").alias("position"),
        F.count(F.lit(1)).alias("copies"),
    )
    if stored is None:
        flagged = first.withColumn("_stored", F.lit(False))
    else:
        flagged = first.join(stored.select(*KEY, F.lit(True).alias("_stored")), KEY, "left").withColumn(
            "_stored", F.coalesce("_stored", F.lit(False))
        )
    loaded = flagged.where(~F.col("_stored")).select(*KEY, "payload", "position")
    surplus = flagged.select(
        *KEY, (F.col("copies") - F.when(F.col("_stored"), 0).otherwise(1)).alias("rejected_rows")
    ).where("rejected_rows > 0")
    unusable = (
        records.where(~is_loadable())
        .agg(F.count(F.lit(1)).alias("rejected_rows"))
        .where("rejected_rows > 0")
        .select(F.lit(None).cast("string").alias(KEY[0]), F.lit(None).cast("string").alias(KEY[1]), "rejected_rows")
    )
    return loaded, surplus.unionByName(unusable)


def rejected_keys(rejected: DataFrame, target_table: str) -> DataFrame:
    """Reject keys with how many rows each stands for."""
    key = F.when(F.col("source_system").isNull(), f"{target_table}:missing_source_or_payload").otherwise(
        F.concat_ws(":", F.lit(target_table), *[F.col(name) for name in KEY])
    )
    return rejected.select(key.alias("rejected_key"), F.col("rejected_rows").cast("bigint").alias("rejected_rows"))
