"""A training corpus from `documents`: quality rules, near-duplicates, benchmark leaks, secrets, pieces.

    spark-submit corpus_pipeline.py <folder of the tables> <output folder>

Each stage takes (spark, docs, folder of the tables) and works on all rows that the stage before kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined results: a null or empty text fails the base rules of the first stage, so no later stage sees one. Rows that are repeated
with their text are near-duplicates of each other: one of them stays; a null id is an id like others. Without good labels the ratio keeps all
that pass the base rules; an empty benchmark drops nothing; empty documents give an empty result. Other columns, whatever
their names, are passed on; `piece_ids` and `decodes` are replaced.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import common, decontaminate, near_dup, pieces, quality_rules, secrets


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep."""
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(spark, folder))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return near_dup.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark, word for word or with few changed words."""
    return decontaminate.drop_leaks(docs, common.read(spark, folder, "benchmark"), edited=True)


def secret_redaction(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secrets.redact(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents with the ids of their pieces, decoded again in the same task: `decodes` says that the text came back."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scan", secret_redaction),
    ("piece encoding", piece_ids),
]
#: The field of the secret scan, the signatures and the pieces have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents")
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, folder), name.replace(" ", "-"))
    return docs


if __name__ == "__main__":
    session = SparkSession.builder.appName("corpus").getOrCreate()
    run(session, sys.argv[1]).write.parquet(sys.argv[2])
