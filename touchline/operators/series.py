"""Ordered computations per entity: positions, displacement and speed, moving averages, gates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as G
from touchline.operators.ordered import SHARD, pieces, shard_of, with_neighbours
from touchline.session import ship


def positions(df: DataFrame, keys: Sequence[str], order: str, width: int = 4096, name: str = "position") -> DataFrame:
    """Number the rows of each key from 1 in the given order, which is unique within the key.

    Counts of the shards before a row's own are added to its number within the shard.
    """
    keys = list(keys)
    rows = df.withColumn(SHARD, shard_of(F.col(order), width))
    counts = rows.groupBy(*keys, SHARD).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(SHARD)
    before = counts.select(*keys, SHARD, (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*keys, SHARD).orderBy(order))
    return rows.withColumn("_rank", rank).join(before, [*keys, SHARD]).withColumn(name, F.col("_before") + F.col("_rank")).drop(SHARD, "_rank", "_before")


def batches(df: DataFrame, keys: Sequence[str], order: str, size: int) -> DataFrame:
    """Batch number, from 0, of each row when `size` rows at a time are read in order."""
    return positions(df, keys, order).withColumn("batch_id", F.floor((F.col("position") - 1) / size).cast("long"))


def movement(states: DataFrame, frames_per_second: float = 25.0, width: int = 4096) -> DataFrame:
    """Displacement and speed from each player's former reading; null for the first one.

    `states` has one row per player and frame. The sign of dx and dy is former minus present position.
    """
    rows = states.select("player_id", "frame_number", "dx_meters", "dy_meters").withColumn(SHARD, shard_of(F.col("frame_number"), width))
    rows = with_neighbours(rows, ["player_id"], "frame_number", ["dx_meters", "dy_meters"])
    rows = rows.withColumn("delta_x", F.col("_prev.dx_meters") - F.col("dx_meters")).withColumn("delta_y", F.col("_prev.dy_meters") - F.col("dy_meters"))
    dt = (F.col("frame_number") - F.col("_prev.frame_number")) / F.lit(frames_per_second)
    k = G.kinematics(F.col("delta_x"), F.col("delta_y"), F.col("_dt"))
    return rows.withColumn("_dt", dt).select(
        "player_id",
        "frame_number",
        "delta_x",
        "delta_y",
        F.sqrt(F.col("delta_x") * F.col("delta_x") + F.col("delta_y") * F.col("delta_y")).alias("displacement"),
        *[k[c].alias(c) for c in ("vx", "vy", "acceleration", "speed_kmh")],
    )


def moving_average(df: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float = 0.2, width: int = 1024, name: str = "ema") -> DataFrame:
    """Exponential moving average with a start of 0, over rows of unique order within the key; null values are skipped.

    A block of a shard is an affine map of the average before it. Within a block the average is a scaled running sum; the
    average before it is made of the blocks within the horizon beyond which a weight vanishes, a bounded number.
    """
    keys = list(keys)
    keep = 1 - alpha
    rows = df.where(F.col(value).isNotNull()).withColumn(SHARD, shard_of(F.col(order), width))
    # a block holds at most 256 rows, so that powers of `keep` stay in range
    inner = Window.partitionBy(*keys, SHARD).orderBy(order)
    rows = rows.withColumn("_r", F.row_number().over(inner)).withColumn("_block", F.floor((F.col("_r") - 1) / 256).cast("int"))
    block = Window.partitionBy(*keys, SHARD, "_block").orderBy(order)
    k = F.row_number().over(block)
    rows = rows.withColumn("_k", k)
    scaled = F.sum(alpha * F.col(value) * F.pow(F.lit(keep), -F.col("_k"))).over(block.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_own", scaled * F.pow(F.lit(keep), F.col("_k")))
    maps = rows.groupBy(*keys, SHARD, "_block").agg(F.max("_k").alias("_n"), F.max_by("_own", "_k").alias("_b"))
    across = Window.partitionBy(*keys).orderBy(SHARD, "_block")
    maps = maps.withColumn("_upto", F.sum("_n").over(across))
    # rows so far back that nothing of them is left in a double don't take part, which bounds the blocks that do
    horizon = math.ceil(math.log(1e-30) / math.log(keep))
    near = Window.partitionBy(*keys).orderBy("_upto").rangeBetween(-(horizon + 256), -1)
    parts = F.collect_list(F.struct("_upto", "_b")).over(near)
    start = F.aggregate("_parts", F.lit(0.0), lambda acc, m: acc + m["_b"] * F.pow(F.lit(keep), F.col("_upto") - F.col("_n") - m["_upto"]))
    starts = maps.withColumn("_parts", parts).select(*keys, SHARD, "_block", start.alias("_start"))
    return rows.join(starts, [*keys, SHARD, "_block"]).withColumn(name, F.col("_own") + F.col("_start") * F.pow(F.lit(keep), F.col("_k"))).drop(SHARD, "_r", "_block", "_k", "_own", "_start")


def _gate(frames: int, change: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last_frame, last_scale = None, None, 0.0
        for b in batches:
            fired = []
            for key, piece, frame, scale in zip(*(b.column(c).to_pylist() for c in ("key", "_piece", "frame", "scale")), strict=True):
                if (key, piece) != held:
                    held, last_frame, last_scale = (key, piece), None, 0.0
                jump = abs(scale - last_scale) / last_scale if last_scale != 0 else 0.0
                fire = last_frame is None or jump > change or frame - last_frame >= frames
                if fire:
                    last_frame, last_scale = frame, scale
                fired.append(fire)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("frame"), b.column("scale"), pa.array(fired)], names=["key", "frame", "scale", "fired"])

    return run


def gate(df: DataFrame, key: str, order: str, scale: str, frames: int = 250, change: float = 0.05, width: int = 4096) -> DataFrame:
    """Which rows fire: the first, one whose scale has changed by more than `change`, or `frames` after the last firing.

    A firing depends on the one before it, so rows are read one after the other. But a row that comes `frames` or more
    after its predecessor fires whatever came before: the rows of a key are cut there, and the pieces are read in
    parallel. Within a piece the state is two numbers and rows are streamed.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("frame"), F.col(scale).cast("double").alias("scale")).dropna()
    cut = pieces(rows.withColumn(SHARD, shard_of(F.col("frame"), width)), ["key"], "frame", ["scale"], frames)
    return (
        cut.repartition("key", "_piece")
        .sortWithinPartitions("key", "_piece", "frame")
        .mapInArrow(_gate(frames, change), "key long, frame long, scale double, fired boolean")
        .select(F.col("key").alias(key), F.col("frame").alias(order), F.col("scale").alias(scale), "fired")
    )
