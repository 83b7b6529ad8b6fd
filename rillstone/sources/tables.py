"""Scans of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tables of the test data.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "miu_record", "eil_record", "audit_sidecar", "rollout_sample", "buffer_item", "reasoning_eval", "miu_raw",
    "category_target", "split_target", "mix_target",
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table, with only the named columns where some are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
