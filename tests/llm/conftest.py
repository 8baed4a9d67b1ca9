"""Small tables for the operators: nulls, empty and very long texts, repeated rows, clashing extra columns."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def make_docs(spark):
    """rows: (doc_id, text); the table has the usual columns, some null, and more whose names clash with outputs."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.select(
            "doc_id",
            "text",
            F.lit(None).cast("string").alias("lang"),
            F.lit("s").alias("source"),
            F.length("text").cast("long").alias("n_chars"),
            F.lit("x").alias("score"),
            F.lit(0).alias("kept"),
            F.lit("y").alias("labels"),
            F.lit(1).alias("start"),
        )

    return make
