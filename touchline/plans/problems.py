"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.anomalies import flag_implausible
from touchline.operators.grid import regular_grid
from touchline.operators.intervals import merge_intervals
from touchline.operators.references import Reference, orphan_references, orphan_report
from touchline.plans import oracles
from touchline.sources.tables import table


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """Positions of every player on a grid of 25 frames."""
    return regular_grid(table(spark, d, "players_states"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_grid(spark, d).where("status <> 'observed'").select("player_id", "grid_frame")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(table(spark, d, "track_summaries"))


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    """Implausible measurements with their reason and value."""
    return flag_implausible(table(spark, d, "players_states")).select(F.col("id").alias("state_id"), "field", "reason", "value")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_flags(spark, d).select("state_id", "field")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    references = [
        Reference("players_states", table(spark, d, "players_states"), (("player_id", "players"), ("ball_id", "ball_states"))),
        Reference("players_numbers", table(spark, d, "players_numbers"), (("player_id", "players"),)),
    ]
    return orphan_references(references, {t: table(spark, d, t) for t in ("players", "ball_states")})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_field", "ref_id", "kind")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, kind and day."""
    return orphan_report(_orphans(spark, d)).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


QUERIES = {f.__name__: f for f in (p1_grid, p1_found, p4_found, p5_flags, p5_found, p6_found, p6_report)}
ORACLES = {"p1_found": oracles.P1_FOUND, "p4_found": oracles.P4_FOUND, "p6_found": oracles.P6_FOUND, "p6_report": oracles.P6_REPORT}
