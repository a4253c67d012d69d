"""The analysis of one match: named steps from frames to report, with a log of their outcome."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import reid, reports, versions
from touchline.operators.detection import Detectors, last_colours, state_colours, track
from touchline.operators.lookup import lookup_join
from touchline.operators.reports import Timer
from touchline.session import written
from touchline.settings import Settings

Tables = dict[str, DataFrame]
Step = Callable[[Tables], Tables]
LOG = "step_number int, name string, outcome string, message string"


@dataclass
class Pipeline:
    """Steps take and give named tables. A failing step is tried again `attempts` - 1 times, then stops the run."""

    spark: SparkSession
    match_id: int
    attempts: int = 1
    steps: list[tuple[str, Step]] = field(default_factory=list)
    log: list[tuple[int, str, str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.timer = Timer(self.match_id)

    def add(self, name: str, step: Step) -> Pipeline:
        self.steps.append((name, step))
        return self

    def run(self, tables: Tables) -> Tables:
        for number, (name, step) in enumerate(self.steps, 1):
            for attempt in range(1, self.attempts + 1):
                try:
                    with self.timer.measured(name):
                        tables = tables | step(tables)
                    self.log.append((number, name, "done", ""))
                    break
                except Exception as e:
                    self.log.append((number, name, "failed", str(e)[:500]))
                    if attempt == self.attempts:
                        raise
        return tables

    def log_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, LOG)


def detect_step(detectors: Detectors, settings: Settings) -> Step:
    """Detections of all registered models over whole frames, with the time of their frame.

    Players without an identity get one by overlap with the frames before, per detector and class; balls and goals have
    none, track_id 0.
    """

    def step(t: Tables) -> Tables:
        found = written(detectors.run_named(t["frames"]), "found")
        parts = [found.where("kind <> 'player'").withColumn("track_id", F.lit(0))]
        for d in detectors.items:
            if d.kind == "player":
                for c in d.classes:
                    of = (F.col("detector") == d.name) & (F.col("class_id") == c)
                    parts.append(track(found.where(of), settings.track_buffer).withColumns({"detector": F.lit(d.name), "kind": F.lit(d.kind)}))
        times = t["frames"].groupBy("match_id", "frame_num").agg(F.min("timestamp").cast("int").alias("timestamp"))
        every = lookup_join(reduce(DataFrame.unionByName, parts), written(times, "times"), ["match_id", "frame_num"], "left")
        return {"detections": written(every, "detections")}

    return step


def _sightings(detections: DataFrame, kind: str) -> DataFrame:
    """Rows of balls or goals, one per detection."""
    box = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    key = F.xxhash64("match_id", "detector", "class_id", "frame_num", "x1", "y1", "x2", "y2")
    return detections.where(F.col("kind") == kind).select(key.alias("id"), "match_id", F.col("frame_num").alias("frame_number"), *box, "confidence", "timestamp")


def states_step(t: Tables) -> Tables:
    """Balls, goals, players and players' states from detections, and the colour of each state's crop.

    There is one state per track and frame, the most confident; a track belongs to a match, detector and class.
    A player's colour is the one last seen, null where no picture shows the player. A table "colours" (id, team_color)
    among the given ones takes the place of the crops.
    """
    key = ["match_id", "detector", "class_id", "track_id"]
    found = t["detections"].where("kind = 'player' and track_id > 0")
    rest = ["x1", "y1", "x2", "y2", "confidence", "timestamp"]
    first = F.min_by(F.struct(*rest), F.struct(-F.col("confidence"), *rest[:4]))
    rows = found.groupBy(*key, "frame_num").agg(first.alias("s")).select(*key, "frame_num", "s.*")
    box = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    movement = [F.lit(0.0).alias(c) for c in ("speed_kmh", "distance_meters")]  # the default: no stage computes them
    states = rows.select(F.xxhash64(*key, "frame_num").alias("id"), F.xxhash64(*key).alias("player_id"), F.col("frame_num").alias("frame_number"), *box, "confidence", "timestamp", *movement, "match_id", "track_id")
    states = written(states, "states")
    players = states.select(F.col("player_id").alias("id"), "match_id", "track_id").distinct()
    players = players.withColumn("shirt_number", F.lit(None).cast("int"))
    out = {"states": states.drop("match_id", "track_id"), "balls": _sightings(t["detections"], "ball"), "goals": _sightings(t["detections"], "goal")}
    if "colours" in t:
        colours = t["colours"]
    elif {"frame", "height", "width"} <= set(t["frames"].columns):
        out["state_colours"] = written(state_colours(t["frames"], states), "colours")
        colours = last_colours(out["state_colours"])
    else:
        return out | {"players": players.withColumn("team_color", F.lit(None).cast("string"))}
    return out | {"players": written(players.join(colours, "id", "left"), "players")}


def reidentify_step(t: Tables) -> Tables:
    return {"merges": written(reid.merge_map(reid.candidates(written(reid.track_summaries(t["states"], t["players"]), "tracks"))), "merges")}


def report_step(t: Tables) -> Tables:
    """The detection report after merging, "detections_report", with its aggregates, and "report": detections per player."""
    states = versions.repoint(t["states"], t["merges"], "player_id")
    players = versions.without(t["players"], t["merges"].select("member"), "id")
    rows = written(reports.detection_report(t["goals"], t["balls"], states, players), "report")
    return {
        "detections_report": rows,
        "recognition_frequency": reports.recognition_frequency(rows),
        "average_confidence": reports.average_confidence(rows),
        "tracking_persistence": reports.tracking_persistence(rows),
        "report": states.groupBy("player_id").agg(F.count(F.lit(1)).alias("n_states"), (F.max("frame_number") - F.min("frame_number")).alias("persistence")),
    }


def analyze(spark: SparkSession, frames: DataFrame, match_id: int, detectors: Detectors, settings: Settings | None = None) -> tuple[Tables, Pipeline]:
    settings = settings or Settings.load(spark)
    p = Pipeline(spark, match_id, settings.attempts)
    p.add("detection", detect_step(detectors, settings)).add("states", states_step).add("re-identification", reidentify_step).add("report", report_step)
    return p.run({"frames": frames}), p
