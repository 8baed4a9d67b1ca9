"""Readers of the JSON extracts.

A feed is one file holding a JSON array, or a folder of such files; a folder is how a large feed stays parallel, since
one array cannot be split. Newline-delimited files (``.jsonl``) are split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.sources.contracts import MASTER_FILES, RAW_FEEDS, SNAPSHOT_FILE, Feed

POSITION = "position"


def _files(spark: SparkSession, path: str) -> list[str]:
    """Data files at a path, empty when it does not exist."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    found = [item.getPath() for item in fs.listStatus(target) if item.isFile()]
    return [p.toString() for p in found if not p.getName().startswith(("_", "."))]


def _first_char(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        byte = stream.read()
        while byte in (9, 10, 13, 32):
            byte = stream.read()
        return chr(byte) if byte >= 0 else ""
    finally:
        stream.close()


def read_array(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame | None:
    """Records of one feed with their ``position`` in it, which decides between copies of a record."""
    files = _files(spark, path)
    if not files:
        if required:
            raise FileNotFoundError(f"missing extract: {path}")
        return None
    by_line = all(name.endswith(".jsonl") for name in files)
    if not by_line:
        for name in files:
            if _first_char(spark, name) != "[":
                raise ValueError(f"expected a JSON array in {name}")
    reader = spark.read.schema(schema).option("multiLine", not by_line).option("mode", "FAILFAST")
    rows = reader.json(path)
    # Rows of one file block sit in one partition in file order, so (file, block, row) is the order of the feed.
    return rows.withColumn(
        POSITION,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def read_raw_feeds(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five enveloped feeds: source_system, source_record_id, payload text, position. All are required."""
    return {feed.core: read_raw_feed(spark, folder, feed) for feed in RAW_FEEDS}


def read_raw_feed(spark: SparkSession, folder: str, feed: Feed) -> DataFrame:
    return read_array(spark, f"{folder}/{feed.extract_file}", schemas.ENVELOPE)


def read_masters(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five master extracts as text fields. All are required."""
    return {
        name: read_array(spark, f"{folder}/{file}", _text_schema(schemas.CORE[name]))
        for name, file in MASTER_FILES.items()
    }


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The optional snapshot extract, unwrapped from its envelope where it has one; no rows without the file."""
    fields = _text_schema(schemas.CORE["snapshots"]).replace("telemetry_readings ", "telemetry_readings_json ")
    schema = f"{fields}, payload STRUCT<{fields.replace(' STRING', ': STRING')}>"
    rows = read_array(spark, f"{folder}/{SNAPSHOT_FILE}", schema, required=False)
    names = schemas.column_names(fields)
    if rows is None:
        return spark.createDataFrame([], ", ".join(f"{n} STRING" for n in names)).withColumn(
            POSITION, F.struct(F.lit("").alias("file"), F.lit(0).alias("block"), F.lit(0).alias("row"))
        )
    wrapped = F.col("payload").isNotNull()
    return rows.select(
        *[F.when(wrapped, F.col(f"payload.{n}")).otherwise(F.col(n)).alias(n) for n in names], POSITION
    )


def _text_schema(ddl: str) -> str:
    return ", ".join(f"{name} STRING" for name in schemas.column_names(ddl))
