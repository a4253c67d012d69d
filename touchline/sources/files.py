"""Fixtures and small file helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.tables import table


def tracklets(events: DataFrame) -> DataFrame:
    """Detections derived from events by fixed formulas: tracks of twelve positions, neighbours overlapping in time."""
    rows = events.select("event_id", "event_type", F.expr("event_id div 2500").cast("int").alias("match_id"), (F.col("event_id") % 2500).alias("k"))
    track, pos = F.expr("k div 12"), F.col("k") % 12
    x1, y1 = (track * 53) % 400 + 3 * pos, (track * 37) % 300 + 2 * pos
    return rows.select(
        F.col("event_id").alias("id"),
        "event_type",
        "match_id",
        track.cast("int").alias("track_id"),
        (F.col("match_id") * 1000 + track).alias("player_id"),
        x1.cast("double").alias("x1"),
        y1.cast("double").alias("y1"),
        (x1 + 20 + F.col("event_id") % 7).cast("double").alias("x2"),
        (y1 + 40 + F.col("event_id") % 11).cast("double").alias("y2"),
        (4 * track + pos + 1).cast("int").alias("frame_number"),
        F.expr("cast((4 * (k div 12) + k % 12) div 25 as int)").alias("timestamp"),
        ((50 + (F.col("event_id") * 7) % 50) / 100).alias("confidence"),
        F.concat_ws(",", (track * 29) % 256, (track * 71) % 256, (track * 113) % 256).alias("team_color"),
    )


def goal_frames(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of the goal frame, a table the data lacks: the tracklets of error events."""
    columns = ["id", "match_id", "x1", "y1", "x2", "y2", "frame_number", "timestamp", "confidence"]
    return tracklets(table(spark, d, "events")).where("event_type = 'error'").select(*columns)


def is_directory(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream(spark: SparkSession, d: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A table as a file stream of at most `files_per_batch` files in a micro-batch."""
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, d, name).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path) if is_directory(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
