"""Table access. Every reader leaves column pruning and filter pushdown to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
