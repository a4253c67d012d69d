"""Band joins: rows within a distance on an integer axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.ordered import shard_of


def rows_within(requests: DataFrame, rows: DataFrame, keys: list[str], at: str, position: str, reach: int, low: int = 1, high: str | None = None) -> DataFrame:
    """Each request with each row of its keys at most `reach` away, from `low` up to the request's column `high`.

    Requests are shown to the ranges they touch, of which there are at most two, and join rows of their range only.
    """
    width = 2 * reach + 1
    first = F.greatest(F.col(at) - reach, F.lit(low))
    last = F.col(at) + reach if high is None else F.least(F.col(at) + reach, F.col(high))
    asked = requests.select(*keys, at, *([high] if high else [])).distinct().withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    shown = asked.withColumn("_b", F.explode(F.sequence(shard_of(F.col("_first"), width), shard_of(F.col("_last"), width))))
    met = shown.join(rows.withColumn("_b", shard_of(F.col(position), width)), [*keys, "_b"])
    return met.where(F.col(position).between(F.col("_first"), F.col("_last"))).drop("_b", "_first", "_last")


def count_within(requests: DataFrame, rows: DataFrame, keys: list[str], at: str, position: str, reach: int, low: int = 1) -> DataFrame:
    """Per request, the number of rows of its keys at most `reach` away, from `low` upwards: keys, at, n_near.

    Rows are counted per position before the join, and requests are shown to the ranges they touch, so a request meets
    at most 2 * reach + 1 positions.
    """
    width = 2 * reach + 1
    counts = rows.groupBy(*keys, F.col(position).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", shard_of(F.col("_p"), width))
    asked = requests.select(*keys, at).distinct()
    shown = asked.withColumn("_b", F.explode(F.sequence(shard_of(F.greatest(F.col(at) - reach, F.lit(low)), width), shard_of(F.greatest(F.col(at) + reach, F.lit(low)), width))))
    met = shown.join(counts, [*keys, "_b"]).where((F.col("_p") >= F.greatest(F.col(at) - reach, F.lit(low))) & (F.col("_p") <= F.col(at) + reach))
    return met.groupBy(*keys, at).agg(F.sum("_n").alias("n_near"))
