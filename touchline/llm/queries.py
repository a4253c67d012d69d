"""Queries of the subpackage's problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import mixing, moderation, nearest, oracles, quantiles, runs, tokens
from touchline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Every state with its nearest depth measurement."""
    return nearest.states_with_depth(table(spark, d, "players_states"), table(spark, d, "players"), table(spark, d, "depth_history")).select(
        F.col("left_id").alias("state_id"), F.col("right_id").alias("depth_id"), F.col("entity").alias("match_id"), F.col("left_time").alias("frame_number"), F.col("right_time").alias("frame_num"), "distance"
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_nearest(spark, d).select("state_id", "depth_id")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of speed per player and per match."""
    return quantiles.speed_percentiles(table(spark, d, "players_states"), table(spark, d, "players"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "players_states")).withColumn("has_ball", F.col("has_ball").cast("int"))


def p7_similar(spark: SparkSession, d: str) -> DataFrame:
    """Runs of nearly the same speed, within 1 km/h of the run's mean when merged; zeros, the default of unprocessed rows, are no readings."""
    rows = table(spark, d, "players_states").where("speed_kmh > 0 and speed_kmh < 1000")
    return runs.collapse_runs(rows, value="speed_kmh", max_span=0, max_distance=1.0).withColumn("speed_kmh", F.round("speed_kmh", 9))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents drawn for each mix, with their copies."""
    return mixing.plan_mixes(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of each source in each mix."""
    return mixing.plan_mixes(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every document."""
    documents = table(spark, d, "documents")
    return moderation.score_documents(documents, moderation.fit_moderation(documents, table(spark, d, "moderation_labels")))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of flagged documents per source."""
    return moderation.rates_by_source(p10_scores(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("flagged").select("doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p2_nearest, p2_found, p3_percentiles, p7_found, p7_similar, p8_ids, p9_mix, p9_shares, p10_scores, p10_rates, p10_found)
}
ORACLES: dict[str, str] = {"p2_nearest": oracles.P2_NEAREST, "p2_found": oracles.P2_FOUND, "p7_found": oracles.P7_FOUND}
