"""Appending sinks: rows are added to a table in batches, and a batch that is written again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append(rows: DataFrame, path: str, batch: str) -> None:
    """Add the rows as a batch of the table at `path`. The batch's number makes a retry harmless: it overwrites its own rows only."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of all batches of a table."""
    return spark.read.schema(schema).option("basePath", path).parquet(path).drop("batch")
