"""The raw load as a stream over a folder that receives extract files.

Feeds arrive every few minutes. Reading new files as they land needs no new rules: each micro-batch
is one raw load against the keys stored so far, of which only the partitions it may repeat are read, so redelivered records are rejected like in any later run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline import schemas
from faultline.operators.raw_load import split_duplicates
from faultline.sources.contracts import Feed
from faultline.sources.keyed import KeyIndex


def start_raw_feed(spark: SparkSession, landing_dir: str, table_dir: str, state_dir: str, feed: Feed) -> StreamingQuery:
    """Load what is in ``landing_dir`` and stop. Each batch owns one folder, so a retried batch replaces itself."""
    target = f"{table_dir}/{feed.target_table}"
    rows = spark.readStream.schema(schemas.ENVELOPE).option("multiLine", True).json(landing_dir)
    named = rows.withColumn("file", F.col("_metadata.file_path"))

    def load(batch: DataFrame, batch_id: int) -> None:
        # A micro-batch is a plain table, where rows of a file keep their order.
        position = F.struct("file", F.monotonically_increasing_id().alias("row"))
        batch = batch.withColumn("position", position).drop("file")
        index, part = KeyIndex(spark, f"{table_dir}/index/{feed.target_table}"), f"{batch_id:012d}"
        stored = None
        if batch_id > 0:
            stored = index.stored_among(batch, lambda rows: rows.where(F.col("part") < part))
        loaded, _ = split_duplicates(batch, stored)
        path = f"{target}/batch_id={batch_id}"
        loaded.drop("position").write.mode("overwrite").parquet(path)
        index.add(spark.read.schema(schemas.ENVELOPE).parquet(path), part)

    return (
        named.writeStream.foreachBatch(load)
        .option("checkpointLocation", f"{state_dir}/{feed.target_table}")
        .trigger(availableNow=True)
        .start()
    )
