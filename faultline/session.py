"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession

EXPLODE_FILTER = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def configure(spark: SparkSession) -> SparkSession:
    """Settings every job relies on: UTC wall-clock arithmetic and runtime re-planning with skew handling.

    Constraint propagation is off: with the many computed columns here it makes the optimizer spend minutes on a plan,
    and all it would add are not-null filters on keys that are never null. So is the filter on the size of an array before
    its explode: pushed below the projection that builds the array, it would build every array twice.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    rules = [rule for rule in spark.conf.get("spark.sql.optimizer.excludedRules", "").split(",") if rule]
    if EXPLODE_FILTER not in rules:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join([*rules, EXPLODE_FILTER]))
    # Else shuffle files of finished steps stay on local disks until the driver happens to collect its garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. It comes from the cluster; only local runs may pick their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in reliable storage: compressed columns that later steps read by what they need, unlike row objects."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(work: Callable[[Any], Any], items: Iterable[Any]) -> list:
    """Steps that don't wait for each other: while one is planned or its last tasks run, the others use the cores."""
    items = list(items)
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(work, items))
