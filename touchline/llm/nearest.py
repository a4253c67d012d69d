"""Pairing records of two tables by nearest time: nearest-neighbour intervals and a bucketed range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.lookup import lookup_join
from touchline.operators.ordered import shard_of

#: Time units of one bucket of the interval index. A bucket meets at most so many disjoint intervals.
BUCKET = 64


def nearest_intervals(right: DataFrame, entity: str, time: str, row_id: str, tolerance: int) -> DataFrame:
    """Intervals (entity, lo, hi, r_time, r_id) of the times that have this right-side row as their nearest.

    Intervals of an entity are disjoint: bounded by the midpoints to the neighbours and by the tolerance. A midpoint
    belongs to the earlier row; of rows at the same time the smallest id stands.

    Neighbours farther than twice the tolerance don't bound an interval, so each row is also shown to the adjacent
    stretch of time if it lies that near; windows run over (entity, stretch), never over a whole entity.
    """
    reach = 2 * tolerance + 1
    width = max(1024, 4 * reach)
    rows = (
        right.select(F.col(entity).alias("entity"), F.col(time).cast("long").alias("r_time"), F.col(row_id).cast("long").alias("r_id"))
        .dropna()
        .groupBy("entity", "r_time")
        .agg(F.min("r_id").alias("r_id"))
    )
    own = shard_of(F.col("r_time"), width)
    shown = rows.withColumn("_own", own).withColumn(
        "_stretch", F.explode(F.sequence(shard_of(F.col("r_time") - reach, width), shard_of(F.col("r_time") + reach, width)))
    )
    w = Window.partitionBy("entity", "_stretch").orderBy("r_time")
    before, after = F.lag("r_time").over(w), F.lead("r_time").over(w)
    half = lambda x: F.floor(x / F.lit(2.0)).cast("long")
    return (
        shown.withColumn("lo", F.greatest(F.col("r_time") - tolerance, half(before + F.col("r_time")) + 1))
        .withColumn("hi", F.least(F.col("r_time") + tolerance, half(after + F.col("r_time"))))
        .where("_own = _stretch")
        .select("entity", "lo", "hi", "r_time", "r_id")
    )


def match_nearest(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    tolerance: int,
    bucket: int = BUCKET,
) -> DataFrame:
    """Left rows with the nearest right row of the same entity at most `tolerance` time units away.

    Columns: left_id, right_id, entity, left_time, right_time, distance (right minus left). Left rows without such a
    right row don't come out. Ties: the earlier right row; on the same time, the smaller id. Exact copies of left rows
    come out once; left rows with different ids each come out.

    Intervals are cut at bucket borders, and a left row meets only the intervals of its own bucket, of which there are
    at most `bucket`; a busy entity spreads over its buckets. Rows with a null entity, time or id pair with nothing.
    Empty tables give no rows; other columns are ignored.
    """
    spans = nearest_intervals(right, entity, right_time, right_id, tolerance)
    spans = spans.withColumn("_b", F.explode(F.sequence(shard_of(F.col("lo"), bucket), shard_of(F.col("hi"), bucket))))
    rows = (
        left.select(F.col(entity).alias("entity"), F.col(left_time).cast("long").alias("l_time"), F.col(left_id).cast("long").alias("l_id"))
        .dropna()
        .distinct()  # copies go before the shuffle by bucket
        .withColumn("_b", shard_of(F.col("l_time"), bucket))
    )
    return rows.join(spans, ["entity", "_b"]).where("l_time between lo and hi").select(
        F.col("l_id").alias("left_id"),
        F.col("r_id").alias("right_id"),
        "entity",
        F.col("l_time").cast("int").alias("left_time"),
        F.col("r_time").cast("int").alias("right_time"),
        (F.col("r_time") - F.col("l_time")).cast("int").alias("distance"),
    )


def states_with_depth(states: DataFrame, players: DataFrame, depths: DataFrame, tolerance: int = 75) -> DataFrame:
    """Each player state with the nearest depth measurement of its player's match; see `match_nearest`.

    A player's match is that of any of its versions; a player without a match pairs with nothing.
    """
    matches = players.select(F.col("id").alias("player_id"), "match_id").dropna().distinct()
    placed = lookup_join(states.select("id", "player_id", "frame_number"), matches, ["player_id"])
    return match_nearest(placed, depths, "match_id", "frame_number", "frame_num", "id", "id", tolerance)
