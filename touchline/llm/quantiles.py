"""Percentiles of very large columns: mergeable KLL sketches, randomised hierarchies of compactors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.lookup import lookup_join
from touchline.operators.ordered import SHARD, shard_of

#: Size parameter of the sketches and its rank error: with k = 400 a quantile's true rank lies within 0.7 percentage
#: points of the asked one, with 99 % probability. Groups of fewer than k values are exact.
K = 400
RANK_ERROR = 0.007
PROBABILITIES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def sketches(df: DataFrame, keys: Sequence[str], value: str, sound: Column, k: int = K) -> DataFrame:
    """One sketch per key: keys, sketch (binary), n (values in it), n_null, n_unsound.

    A compactor keeps a bounded buffer; when it is full it sorts it, keeps every other value from a random start and
    hands these on to the next level at twice the weight. The partial aggregation does this before the shuffle, so a
    hot key sends one bounded sketch from each task.
    """
    v = F.col(value).cast("double")
    ok = F.col(value).isNotNull() & F.coalesce(sound, F.lit(False))
    return df.groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.when(ok, v), F.lit(k)).alias("sketch"),
        F.sum(ok.cast("long")).alias("n"),
        F.sum(F.col(value).isNull().cast("long")).alias("n_null"),
        F.sum((F.col(value).isNotNull() & ~ok).cast("long")).alias("n_unsound"),
    )


def merge_sketches(parts: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Merge sketches of slices, days or members level by level into one sketch per key, with the counts added up."""
    return parts.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), *[F.sum(c).alias(c) for c in ("n", "n_null", "n_unsound")]
    )


def read_quantiles(parts: DataFrame, keys: Sequence[str], probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    """keys, n, n_null, n_unsound, rank_error, and one column p<percent> per probability; null for keys without values.

    rank_error is 0 where the sketch never had to compact.
    """
    asked = [F.when(F.col("n") > 0, F.call_function("kll_sketch_get_quantile_double", F.when(F.col("n") > 0, F.col("sketch")), F.lit(float(p)))) for p in probabilities]
    names = [f"p{p * 100:g}".replace(".", "_") for p in probabilities]
    return parts.select(
        *keys,
        "n",
        "n_null",
        "n_unsound",
        F.when(F.col("n") < K, 0.0).otherwise(RANK_ERROR).alias("rank_error"),
        *[a.alias(n) for a, n in zip(asked, names, strict=True)],
    )


def speed_sketches(states: DataFrame, players: DataFrame, highest: float = 60.0, slice_frames: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Sketches of speed_kmh per player and per match.

    Exact copies and second readings (equal speed of a player and frame) count once. Zero is the default of unprocessed
    rows; zeros, negative, infinite or NaN values and values above `highest` are counted as unsound and left out of the
    quantiles. A player's match is that of any of its versions; players without one take part under a null match.
    """
    speed = F.col("speed_kmh")
    rows = (
        states.where("player_id is not null")
        .select("player_id", "frame_number", "speed_kmh")
        .withColumn(SHARD, F.coalesce(shard_of(F.col("frame_number"), slice_frames), F.lit(0)))
        .distinct()  # copies go before the shuffle by slice, which keeps a player's rows together for the partial sketches
        .repartition("player_id", SHARD)
    )
    per_player = sketches(rows, ["player_id"], "speed_kmh", (speed > 0) & (speed <= highest) & ~F.isnan(speed))
    matches = players.select(F.col("id").alias("player_id"), "match_id").where("player_id is not null").distinct()
    per_match = merge_sketches(lookup_join(per_player, matches, ["player_id"], "left"), ["match_id"])
    return per_player, per_match


def speed_percentiles(states: DataFrame, players: DataFrame) -> DataFrame:
    """Percentiles per player and per match: level ("player" or "match"), group_id, counts, rank_error, p1 … p99.

    Nulls in speed_kmh are counted; rows without player_id are left out; an empty table gives no rows.
    """
    per_player, per_match = speed_sketches(states, players)
    levels = []
    for name, df, key in (("player", per_player, "player_id"), ("match", per_match, "match_id")):
        levels.append(read_quantiles(df, [key]).withColumn("level", F.lit(name)).withColumn("group_id", F.col(key).cast("long")).drop(key))
    both = levels[0].unionByName(levels[1])
    return both.select("level", "group_id", *[c for c in both.columns if c not in ("level", "group_id")])
