"""The stored tables: reading them, and their record schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings runs facts evidence "
    "fetched_documents method_trust field_aliases latency_claims mix_targets pack_sizes"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder; columns are pruned and filters pushed to the scan by the planner."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
