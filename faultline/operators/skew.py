"""Ordered work over keys of any size.

A window puts one key into one task. When a key may hold a large share of all rows, its ordered rows are cut into
range partitions ("chunks") that each fit a task, the work is done per chunk, and a small per-chunk summary carries
the state across chunk borders. Keys below the limit stay in one chunk and pay one counting pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import checkpoint

HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Chunked:
    """Rows with a ``chunk`` column; chunks of a key ascend in the requested order."""

    df: DataFrame
    keys: list[str]
    split: bool

    @property
    def partition_keys(self) -> list[str]:
        return [*self.keys, "chunk"] if self.split else self.keys


def hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``limit`` rows: at most rows/limit of them. Counting combines map-side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows")).where(F.col("key_rows") > limit)


def chunk_hot_keys(df: DataFrame, keys: list[str], order: list[str], limit: int | None = HOT_ROWS) -> Chunked:
    """``limit=None`` says the caller already knows that no key is hot."""
    whole = Chunked(df.withColumn("chunk", F.lit(-1)), keys, False)
    if limit is None:
        return whole
    hot = hot_keys(df, keys, limit)
    largest = hot.agg(F.sum("key_rows")).first()[0]
    if largest is None:
        return whole
    hot = hot.select(*keys)
    ordinary = df.join(hot, keys, "left_anti").withColumn("chunk", F.lit(-1))
    pieces = max(2, 2 * -(-largest // limit))
    # The chunk number is the range partition a row landed in. It is written to the checkpoint folder so that a lost
    # executor cannot recompute it with other range bounds.
    large = checkpoint(
        df.join(hot, keys, "left_semi")
        .repartitionByRange(int(pieces), *keys, *order)
        .withColumn("chunk", F.spark_partition_id())
    )
    return Chunked(ordinary.unionByName(large), keys, True)


def spread_nulls(key: Column, *by: str | Column) -> Column:
    """A text key for an outer join in which rows without key match nothing, as before, but don't all meet in one task."""
    nothing = F.concat(F.lit("\u0000"), F.xxhash64(*by).cast("string"))
    return F.coalesce(key, nothing)


def ends(df: DataFrame, keys: list[str], order: list[str], item: str) -> DataFrame:
    """How many items each key has, and which are the first and the last: one row per key at every size."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(item, place).alias("first"), F.max_by(item, place).alias("last")
    )


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1..n over the whole table without a one-task window: range sort, then add each partition's offset."""
    # A range sort reads its input twice, first for the bounds, so the input is written before.
    placed = checkpoint(checkpoint(df).orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per sort partition, so this window and its broadcast are bounded by the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    position = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + position + 1).cast("bigint"))
        .drop("_part", "_place", "_offset")
    )


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The n first rows of each group. Spark limits each group before the shuffle, so hot groups stay small."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def nearest_rank(freq: DataFrame, group: list[str], value: str, weight: str, fraction: float) -> DataFrame:
    """Weighted nearest-rank percentile of microsecond values for groups too large for one window.

    ``freq`` has one row per (group, value); the result is group + ``picked``. The rank is the rounded (half to even)
    fraction of n-1, not an interpolation. It is narrowed down hour -> second -> microsecond: no window sees more rows
    than there are hours in the data, seconds in an hour, or microseconds in a second.
    """
    remaining, target = freq, None
    for width in (3_600_000_000, 1_000_000, 1):
        bucket = F.floor(F.col(value) / F.lit(width)).cast("bigint")
        binned = remaining.groupBy(*group, bucket.alias("_bin")).agg(F.sum(weight).alias("_n"))
        running = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        binned = binned.withColumn("_upto", F.sum("_n").over(running))
        if target is None:
            total = F.sum("_n").over(Window.partitionBy(*group))
            binned = binned.withColumn("_rank", F.rint((total - 1) * F.lit(fraction)).cast("bigint"))
        else:
            binned = binned.join(target.select(*group, "_rank"), group)
        hit = (F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank"))
        target = binned.where(hit).select(
            *group, "_bin", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank")
        )
        remaining = (
            remaining.withColumn("_bin", bucket).join(target.select(*group, "_bin"), [*group, "_bin"]).drop("_bin")
        )
    return target.select(*group, F.col("_bin").alias("picked"))
