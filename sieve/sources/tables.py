"""Table source for Parquet data (the test tables and any Parquet lake)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read ``<base_dir>/<name>.parquet``; Catalyst pushes filters and prunes columns into the scan."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def read_tables(spark: SparkSession, base_dir: str, names=TEST_TABLES) -> dict[str, DataFrame]:
    return {n: read_table(spark, base_dir, n) for n in names}


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Expose DataFrames to ``spark.sql`` under their names (custom SQL checks)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
