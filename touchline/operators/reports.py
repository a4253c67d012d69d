"""The detection report and its aggregates, timing statistics, and their files."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.text import box_text, text_or_none
from touchline.operators.lookup import lookup_join

# The report's columns.
COLUMNS = ["frame_number", "object_type", "track_id", "bbox", "confidence", "shirt_color", "shirt_number", "speed", "distance", "timestamp"]
CSV_SCHEMA = (
    "frame_number int, object_type string, track_id int, bbox string, confidence double, shirt_color string, shirt_number string, "
    "speed double, distance double, timestamp int"
)


def detection_report(goals: DataFrame, balls: DataFrame, states: DataFrame, players: DataFrame) -> DataFrame:
    """One row per detection of any kind, with the match it belongs to. Goals and balls have no shirt ("") and don't move (0)."""
    box = box_text(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    empty = {"shirt_color": F.lit(""), "shirt_number": F.lit(""), "speed": F.lit(0.0), "distance": F.lit(0.0)}

    def rows(df: DataFrame, kind: str, **more) -> DataFrame:
        own = {"object_type": F.lit(kind), "track_id": F.lit(0), "bbox": box, **empty, **more}
        return df.select("match_id", *[own.get(c, F.col(c)).alias(c) for c in COLUMNS])

    known = players.select(F.col("id").alias("player_id"), "match_id", "track_id", "team_color", "shirt_number")
    joined = lookup_join(states, known, ["player_id"])
    player_rows = rows(
        joined, "player", track_id=F.col("track_id"), shirt_color=F.col("team_color"), shirt_number=text_or_none(F.col("shirt_number")), speed=F.col("speed_kmh"), distance=F.col("distance_meters")
    )
    return rows(goals, "goal").unionByName(rows(balls, "ball")).unionByName(player_rows)


def _numbered(report: DataFrame) -> DataFrame:
    """Player rows with a shirt number; "None" stands for no number and forms no group."""
    return report.where("object_type = 'player' and shirt_number is not null and shirt_number <> 'None'")


def recognition_frequency(report: DataFrame) -> DataFrame:
    return _numbered(report).groupBy("shirt_number").agg(F.count(F.lit(1)).alias("frequency")).orderBy(F.desc("frequency"), "shirt_number")


def average_confidence(report: DataFrame) -> DataFrame:
    return _numbered(report).groupBy("shirt_number").agg(F.round(F.avg("confidence"), 6).alias("avg_confidence")).orderBy(F.desc("avg_confidence"), "shirt_number")


def tracking_persistence(report: DataFrame) -> DataFrame:
    return _numbered(report).groupBy("shirt_number").agg((F.max("frame_number") - F.min("frame_number")).alias("persistence")).orderBy(F.desc("persistence"), "shirt_number")


def write_csv(report: DataFrame, path: str) -> None:
    report.select(*COLUMNS).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A written report; the text "None" and empty text read as null."""
    rows = spark.read.schema(CSV_SCHEMA).csv(path, header=True, nullValue="None")
    return rows.select(*[F.nullif(c, F.lit("")).alias(c) if t == "string" else c for c, t in rows.dtypes])


def timing_stats(samples: DataFrame, name: str, duration: str) -> DataFrame:
    d = F.col(duration)
    return samples.groupBy(F.col(name).alias("process")).agg(F.count(d).alias("count"), F.round(F.sum(d), 6).alias("total"), F.min(d).alias("min"), F.max(d).alias("max"))


class Timer:
    """Durations of named steps on the driver, published as a JSON report."""

    def __init__(self, match_id: int):
        self.match_id, self.began, self.stats = match_id, {}, {}

    def start(self, name: str) -> None:
        self.began[name] = time.perf_counter()

    def stop(self, name: str) -> float:
        if name not in self.began:
            raise ValueError(f"{name} was not started")
        took = time.perf_counter() - self.began.pop(name)
        s = self.stats.setdefault(name, {"count": 0, "total": 0.0, "min": took, "max": took})
        s.update(count=s["count"] + 1, total=s["total"] + took, min=min(s["min"], took), max=max(s["max"], took))
        return took

    @contextmanager
    def measured(self, name: str):
        self.start(name)
        try:
            yield
        finally:
            self.stop(name)

    def publish(self, path: str) -> None:
        at = time.strftime("%Y-%m-%d %H:%M:%S")
        Path(path).write_text(json.dumps({"metadata": {"match_id": self.match_id, "date_time": at}, "stats": self.stats}, indent=2))
