"""Named queries over the match tables: lookups, versions, re-identification, reports, series and kernels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import colour as C
from touchline.functions import geometry as G
from touchline.functions import text as X
from touchline.operators import bands, detection, reid, reports, series, vectors, versions
from touchline.operators.lookup import lookup_join
from touchline.session import shared_dir, written
from touchline.sources import sinks
from touchline.sources.files import goal_frames, stream
from touchline.sources.frames import metadata
from touchline.sources.tables import table
from touchline.streaming import stateful

STATE = ["id", "player_id", "frame_number", "x1", "y1", "x2", "y2", "confidence", "timestamp"]
BALL = ["id", "match_id", "frame_number", "x1", "y1", "x2", "y2", "confidence", "timestamp"]


def _players(s: SparkSession, d: str) -> DataFrame:
    """Current players: the latest version of each id."""
    return versions.latest_version(table(s, d, "players"), ["id"], ["updated_at"])


def _states(s: SparkSession, d: str, columns: list[str] = STATE) -> DataFrame:
    """One state per player and frame: the one with the smallest id."""
    return versions.first_per_key(table(s, d, "players_states").select(*columns), ["player_id", "frame_number"])


def _balls(s: SparkSession, d: str) -> DataFrame:
    """One row per ball sighting: copies share their id."""
    return versions.first_per_key(table(s, d, "ball_states").select(*BALL), ["id"])


def _matches(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "players").select("match_id").dropna().distinct()


# -- lookups ------------------------------------------------------------------------------------------------------------


def balls_by_match(s, d):
    """Ball sightings of the asked matches, here of every match with players."""
    return lookup_join(_balls(s, d), _matches(s, d), ["match_id"], "left_semi")


def goals_by_match(s, d):
    return lookup_join(goal_frames(s, d), _matches(s, d), ["match_id"], "left_semi")


def players_by_match(s, d):
    asked = table(s, d, "ball_states").select("match_id").dropna().distinct()
    return lookup_join(_players(s, d).select("id", "match_id", "track_id", "team_color", "shirt_number"), asked, ["match_id"], "left_semi")


def state_by_track_frame(s, d):
    """State id per match, track and frame, for every such triple."""
    players = _players(s, d).select(F.col("id").alias("player_id"), "match_id", "track_id")
    return lookup_join(_states(s, d, ["id", "player_id", "frame_number"]), players, ["player_id"]).select("match_id", "track_id", "frame_number", "player_id", F.col("id").alias("state_id"))


def states_by_frame(s, d):
    """States on the frames on which their match's ball was seen."""
    asked = table(s, d, "ball_states").select("match_id", "frame_number").dropna().distinct()
    placed = state_by_track_frame(s, d).select("match_id", "frame_number", "player_id", "state_id")
    return placed.join(asked, ["match_id", "frame_number"], "left_semi")


def states_by_frame_range(s, d):
    """States from the first to the last depth measurement of their match, in frame order."""
    asked = table(s, d, "depth_history").groupBy("match_id").agg(F.min("frame_num").alias("lo"), F.max("frame_num").alias("hi"))
    placed = state_by_track_frame(s, d).select("match_id", "frame_number", "player_id", "state_id")
    return lookup_join(placed, asked, ["match_id"]).where(F.col("frame_number").between(F.col("lo"), F.col("hi"))).drop("lo", "hi").orderBy("match_id", "frame_number", "state_id")


def player_by_id_first(s, d):
    """The first player of each match and track."""
    return _players(s, d).where("match_id is not null").groupBy("match_id", "track_id").agg(F.min("id").alias("player_id"))


def class_conf_filter(s, d):
    """Detections of balls and players at or above their detector's least confidence, as whole pixels."""
    both = (
        table(s, d, "players_states").select("id", F.lit("player").alias("class"), "x1", "y1", "x2", "y2", "confidence")
        .unionByName(table(s, d, "ball_states").select("id", F.lit("ball").alias("class"), "x1", "y1", "x2", "y2", "confidence"))
        .distinct()
    )
    return _confident(both)


def goal_conf_filter(s, d):
    """class_conf_filter of goal-frame sightings, which its SQL doesn't read."""
    return _confident(goal_frames(s, d).select("id", F.lit("goal").alias("class"), "x1", "y1", "x2", "y2", "confidence").distinct())


def _confident(rows: DataFrame) -> DataFrame:
    least = F.element_at(F.create_map(*[F.lit(x) for kv in detection.THRESHOLDS.items() for x in kv]), F.col("class"))
    return rows.withColumn("confidence", F.coalesce("confidence", F.lit(detection.MISSING_CONFIDENCE))).where(F.col("confidence") >= least).select("id", "class", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], "confidence")


# -- versions and mutations -----------------------------------------------------------------------------------------------


def latest_players(s, d):
    return _players(s, d).select("id", "match_id", "track_id", "team_id", "team_color", "goals", "shirt_number", "crop_path")


def player_upsert(s, d):
    """Players by match and track after all partial updates."""
    cols = ["id", "match_id", "track_id", "team_id", "team_color", "goals", "shirt_number", "crop_path", "updated_at"]
    return versions.upsert(table(s, d, "players").select(*cols), ["match_id", "track_id"], ["updated_at", "id"]).drop("updated_at")


def state_insert_if_absent(s, d):
    """States of the first pass, and late ones whose player and frame isn't there yet."""
    rows = table(s, d, "players_states").select("id", "player_id", "frame_number", "confidence").distinct()
    median = rows.selectExpr("percentile_approx(id, 0.5)").first()[0]
    early = versions.first_per_key(rows.where(F.col("id") <= F.lit(median)), ["player_id", "frame_number"])
    return versions.insert_absent(early, rows.where(F.col("id") > F.lit(median)), ["player_id", "frame_number"])


def team_color_last_write(s, d):
    """The colour of each player's last stretch."""
    return table(s, d, "track_summaries").where("avg_color is not null and frame_end is not null").groupBy("player_id").agg(F.max(F.struct("frame_end", "avg_color")).alias("m")).select("player_id", F.col("m.avg_color").alias("team_color"))


def numbers_cascade_delete(s, d):
    """Shirt-number readings that stay when those of unknown players go."""
    rows = table(s, d, "players_numbers").select("id", "player_id", "number", "frame_number").distinct()
    return versions.only_existing(rows, table(s, d, "players").select("id"), "player_id")


def _steps(s, d):
    """Line items as steps of the orders' tasks; the date stands for the time of the change."""
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("step_number"), F.col("l_linestatus").alias("state"), F.col("l_returnflag").alias("message"), F.col("l_shipdate").alias("changed_at"))


def task_latest_state(s, d):
    """Each task with its step that changed last."""
    tasks = table(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("user_id"))
    last = _steps(s, d).groupBy("task_id").agg(F.max(F.struct("changed_at", "step_number", "state")).alias("m"))
    return tasks.join(last, "task_id", "left").select("task_id", "user_id", F.col("m.step_number").alias("step_number"), F.col("m.state").alias("state"))


def task_step_upsert(s, d):
    """Steps after a second pass has set the state and message of every third step anew, and added one step to each task."""
    steps = _steps(s, d)
    again = steps.where("step_number % 3 = 0").select("task_id", "step_number", F.lit("done").alias("state"), F.lit(None).cast("string").alias("message"), (F.col("changed_at") + F.expr("interval 1 day")).alias("changed_at"))
    added = table(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.lit(100).alias("step_number"), F.lit("pending").alias("state"), F.lit("").alias("message"), F.col("o_orderdate").alias("changed_at"))
    return versions.upsert(steps.unionByName(again).unionByName(added), ["task_id", "step_number"], ["changed_at", "state", "message"]).select("task_id", "step_number", "state", "message")


def task_cascade_delete(s, d):
    """Steps that stay when the finished tasks go."""
    kept = table(s, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey")
    return versions.only_existing(_steps(s, d), kept, "task_id").select("task_id", "step_number", "state")


def _appended(rows: DataFrame, name: str) -> DataFrame:
    """Rows appended in two batches, of which the second is written twice, as by a retry."""
    s = rows.sparkSession
    path = f"{shared_dir(s)}/{s.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    half = F.col("frame_number") % 2 == 0
    for batch, part in (("1", rows.where(half)), ("2", rows.where(~half)), ("2", rows.where(~half))):
        sinks.append(part, path, batch)
    return sinks.appended(s, path, rows.schema)


def ball_append(s, d):
    return _appended(_balls(s, d).where("frame_number is not null"), "balls")


def goal_append(s, d):
    return _appended(goal_frames(s, d), "goals")


def state_append(s, d):
    return _appended(_states(s, d).where("frame_number is not null"), "states")


# -- re-identification ----------------------------------------------------------------------------------------------------


def _summaries(s, d):
    return reid.track_summaries(_states(s, d), _players(s, d))


def _pairs(s, d):
    # both sides of the pairs read the summaries, which cost the only pass over the states
    return reid.candidates(written(_summaries(s, d), "tracks"))


def _merges(s, d):
    return written(reid.merge_map(_pairs(s, d)), "merges")


def centroids(s, d):
    return reid.centroids(_states(s, d)).select("id", "player_id", "frame_number", "cx", "cy")


def track_partition_ghosts(s, d):
    return _summaries(s, d).select("player_id", "established", "ghost", "detection_count")


def track_summaries(s, d):
    return _summaries(s, d).select("match_id", "player_id", "frame_start", "frame_end", "detection_count", "avg_color", "first_cx", "first_cy", "last_cx", "last_cy")


def mean_colors(s, d):
    """Per player, the mean colour of its stretches and the tracker of the first one; copies count once."""
    rows = table(s, d, "track_summaries").where("player_id is not null and frame_start is not null").select("player_id", "tracker_id", "frame_start", "avg_color").distinct()
    return rows.groupBy("player_id").agg(F.min(F.struct("frame_start", "tracker_id")).alias("_f"), C.mean_rgb(F.col("avg_color")).alias("mean_color")).select("player_id", F.col("_f.tracker_id").alias("first_tracker"), "mean_color")


def color_distance(s, d):
    """Perceptual distance of each player's colour to black and to white."""
    rgb = C.parse_rgb(F.col("team_color"))
    rows = _players(s, d).select("id", rgb.alias("rgb")).where("rgb is not null")
    own = C.lab(F.col("rgb"))
    return rows.select("id", *[F.round(C.lab_distance(own, C.lab(F.array(*[F.lit(v)] * 3))), 6).alias(n) for n, v in (("to_black", 0), ("to_white", 255))])


def reid_candidates(s, d):
    return _pairs(s, d).select("match_id", "inc_player_id", "cor_player_id", "gap", *[F.round(c, 6).alias(c) for c in ("color_distance", "distance", "score")])


def reid_merge_map(s, d):
    return reid.merge_map(_pairs(s, d)).withColumn("score", F.round("score", 6))


def reid_merged_states(s, d):
    """States with their player after merging."""
    return versions.repoint(_states(s, d, ["id", "player_id", "frame_number"]), _merges(s, d), "player_id")


def reid_merged_numbers(s, d):
    """Shirt-number readings with their player after merging; copies come out once."""
    rows = table(s, d, "players_numbers").select("id", "player_id", "number", "confidence", "frame_number").distinct()
    return versions.repoint(rows, _merges(s, d), "player_id")


def reid_surviving_players(s, d):
    return versions.without(_players(s, d).select("id", "match_id", "track_id"), _merges(s, d).select("member"), "id")


def reid_summary(s, d):
    return _merges(s, d).groupBy("match_id").agg(F.count(F.lit(1)).alias("total_merged"), F.countDistinct("root").alias("n_groups"))


def reid_frame_conflicts(s, d):
    """Players and frames that hold more than one state after merging."""
    return reid_merged_states(s, d).groupBy("player_id", "frame_number").agg(F.count(F.lit(1)).alias("n_states")).where("n_states > 1")


def near_frame_band(s, d):
    """Per depth measurement, the centres of track pieces within 20 frames of its match."""
    pieces = _players(s, d).where(F.col("track_id") > reid.ESTABLISHED).select(F.col("id").alias("player_id"), "match_id")
    points = lookup_join(reid.centroids(_states(s, d)).select("player_id", "frame_number"), pieces, ["player_id"])
    return bands.count_within(table(s, d, "depth_history").where("match_id is not null"), points, ["match_id"], "frame_num", "frame_number", 20)


def near_frame_rows(s, d):
    """Centres of track pieces within 20 frames of a depth measurement of their match, up to the match's last frame."""
    every = _players(s, d).select(F.col("id").alias("player_id"), "match_id", "track_id")
    placed = lookup_join(reid.centroids(_states(s, d)).select("player_id", "frame_number", "cx", "cy"), every, ["player_id"])
    last = placed.groupBy("match_id").agg(F.max("frame_number").alias("last_frame"))
    asked = table(s, d, "depth_history").select("match_id", "frame_num").dropna().distinct().join(last, "match_id")
    pieces = placed.where(F.col("track_id") > reid.ESTABLISHED).drop("track_id")
    return bands.rows_within(asked, pieces, ["match_id"], "frame_num", "frame_number", 20, 1, "last_frame").drop("last_frame")


# -- reports --------------------------------------------------------------------------------------------------------------


def _report(s, d):
    states = _states(s, d, [*STATE, "speed_kmh", "distance_meters"])
    return reports.detection_report(goal_frames(s, d), _balls(s, d), states, _players(s, d))


def detection_report(s, d):
    return _report(s, d)


def report_boxes(s, d):
    """Boxes of the report's balls as text; whole numbers keep one decimal."""
    return _balls(s, d).select("id", X.box_text(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("bbox"))


def recognition_frequency(s, d):
    return reports.recognition_frequency(_report(s, d))


def average_confidence(s, d):
    return reports.average_confidence(_report(s, d))


def tracking_persistence(s, d):
    return reports.tracking_persistence(_report(s, d))


def report_csv_roundtrip(s, d):
    path = f"{shared_dir(s)}/report-{uuid.uuid4().hex}"
    reports.write_csv(_report(s, d), path)
    back = reports.read_csv(s, path)
    return back.groupBy("object_type").agg(F.count(F.lit(1)).alias("n"), F.count("shirt_number").alias("n_numbered"), F.max("frame_number").alias("last_frame"), F.countDistinct("bbox").alias("n_boxes"), F.round(F.sum("speed"), 2).alias("speeds"), F.round(F.sum("confidence"), 4).alias("confidences"))


def step_timing_stats(s, d):
    return reports.timing_stats(table(s, d, "events"), "event_type", "value")


def timing_json_roundtrip(s, d):
    path = f"{shared_dir(s)}/timing-{uuid.uuid4().hex}"
    step_timing_stats(s, d).write.json(path)
    return s.read.schema("process string, count long, total double, min double, max double").json(path)


# -- series ---------------------------------------------------------------------------------------------------------------


def frame_batches(s, d):
    """Frames of each match in reading batches of 32."""
    frames = table(s, d, "ball_states").select("match_id", "frame_number").dropna().distinct()
    return series.batches(frames, ["match_id"], "frame_number", 32).select("match_id", "frame_number", "batch_id")


def _positions(s, d):
    return _states(s, d, ["id", "player_id", "frame_number", "dx_meters", "dy_meters"])


def frame_displacement(s, d):
    return series.movement(_positions(s, d)).select("player_id", "frame_number", *[F.round(c, 6).alias(c) for c in ("delta_x", "delta_y", "displacement")])


def frame_speed(s, d):
    return series.movement(_positions(s, d)).select("player_id", "frame_number", F.round("speed_kmh", 5).alias("speed_kmh"))


def frame_kinematics(s, d):
    """Velocity and acceleration with which each player reached its position."""
    return series.movement(_positions(s, d)).select("player_id", "frame_number", *[F.round(c, 5).alias(c) for c in ("vx", "vy", "acceleration")])


def video_metadata(s, d):
    """Frames, rate and length of each match's video, as far as balls were seen; frames have no picture here."""
    frames = table(s, d, "ball_states").where("match_id is not null and frame_number is not null").select("match_id", F.col("frame_number").alias("frame_num"), ((F.col("frame_number") - 1) / 25).alias("timestamp"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return metadata(frames).withColumn("seconds", F.round("seconds", 6))


def _depths(s, d):
    rows = table(s, d, "depth_history").select("id", "match_id", "frame_num", "depth", "camera_scale").where("match_id is not null and frame_num is not null")
    return versions.first_per_key(rows, ["match_id", "frame_num"])


def depth_ema(s, d):
    """Smoothed distances of each match's depth measurements."""
    rows = _depths(s, d).withColumn("x", G.inverse_depth(F.col("depth"), F.lit(1.0)))
    return series.moving_average(rows, ["match_id"], "frame_num", "x").select("match_id", "frame_num", F.round("ema", 9).alias("ema"), F.round(F.try_divide(F.col("ema") / 10, F.col("camera_scale")), 9).alias("final_depth"))


def depth_gate(s, d):
    return series.gate(_depths(s, d), "match_id", "frame_num", "camera_scale").select(F.col("match_id").cast("int"), F.col("frame_num").cast("int"), "fired")


def depth_constant(s, d):
    return table(s, d, "depth_history").distinct().select("id", (F.col("depth") * F.col("pixels_to_meters") * F.col("camera_scale")).alias("constant"))


def bbox_clamp(s, d):
    """Boxes within a frame of 1920 by 1080; those without area go."""
    x = [G.clamp(F.col(c).cast("int"), F.lit(0), F.lit(1920)).alias(c) for c in ("x1", "x2")]
    y = [G.clamp(F.col(c).cast("int"), F.lit(0), F.lit(1080)).alias(c) for c in ("y1", "y2")]
    return _states(s, d).dropna(subset=["x1", "y1", "x2", "y2"]).select("id", *x, *y).where("x2 > x1 and y2 > y1")


def hip_point(s, d):
    """The hip at 55 % of the box's height, or the box's centre where no pose was found (here: no position)."""
    rows = _states(s, d, [*STATE, "dx_meters"]).dropna(subset=["x1", "y1", "x2", "y2"])
    share = lambda v: F.when(F.col("dx_meters").isNotNull(), F.lit(v))
    return rows.select("id", F.round(G.point_in_box(share(0.5), F.col("x1"), F.col("x2")), 6).alias("hip_x"), F.round(G.point_in_box(share(0.55), F.col("y1"), F.col("y2")), 6).alias("hip_y"))


# -- arrays, strings, enumerations ------------------------------------------------------------------------------------------


def vector_minmax(s, d):
    v = vectors.minmax(F.col("embedding").cast("array<double>"))
    return table(s, d, "embeddings").select("vec_id", F.posexplode(v).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def vector_standardize(s, d):
    return vectors.standardize(table(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id", "embedding").select("vec_id", "pos", F.round("z", 6).alias("z"))


def cluster_pick(s, d):
    """Embeddings as points of one image per group of labels; the label is the cluster."""
    e = F.col("embedding").cast("array<double>")
    points = table(s, d, "embeddings").select(F.lit(1).alias("image"), F.col("label").alias("cluster"), e[0].alias("x"), e[1].alias("y"), e[2].alias("colour"))
    return vectors.pick_cluster(points, "image", 1.0).select("image", "cluster", F.round("score", 6).alias("score"), F.round("colour", 6).alias("colour"))


def hex_color(s, d):
    rgb = C.parse_rgb(F.col("team_color"))
    return _players(s, d).select("id", C.hex_colour(rgb).alias("hex"), F.when(rgb.isNotNull(), C.rgb_text(rgb)).alias("rgb"))


def storage_keys(s, d):
    """Keys of events as stored files; the event's number takes the place of a random part."""
    purpose = F.when(F.col("event_type") == "view", "player_image").when(F.col("event_type") == "click", "heatmap").when(F.col("event_type") == "purchase", "reports").otherwise("other")
    return table(s, d, "events").select("event_id", X.storage_key(F.col("user_id"), F.col("event_type"), purpose, "png", F.col("event_id")).alias("key"))


def label_text(s, d):
    players = _players(s, d).select(F.col("id").alias("player_id"), "match_id", "track_id", C.hex_colour(C.parse_rgb(F.col("team_color"))).alias("hex"))
    placed = lookup_join(_states(s, d, ["id", "player_id", "frame_number", "confidence"]), players, ["player_id"])
    return placed.select("id", X.label(F.col("track_id"), F.coalesce("hex", F.lit("none")), F.col("confidence")).alias("label"), X.image_name(F.col("match_id"), F.col("frame_number"), F.col("track_id")).alias("image_name"))


def enum_map(s, d):
    """The depth models by name, and the number of measurements each could serve."""
    names = ("DPT_Large", "DPT_Hybrid", "MiDaS_small")
    models = F.create_map(*[F.lit(x) for n in names for x in (n, n)])
    return table(s, d, "depth_history").agg(F.count(F.lit(1)).alias("n")).select(F.explode(models).alias("name", "value"), "n")


def crop_slice(s, d):
    """The middle of each embedding seen as an image of 8 by 8."""
    v = vectors.crop(F.col("embedding").cast("array<double>"), 8, 2, 1, 6, 4)
    return table(s, d, "embeddings").select("vec_id", F.posexplode(v).alias("pos", "x"))


def grid_sample(s, d):
    """Embeddings as images of 8 by 8, sampled at a grid point that may lie outside."""
    x, y = F.col("vec_id") % 11 - 1, F.col("vec_id") % 13 - 2
    return table(s, d, "embeddings").select("vec_id", vectors.sample(F.col("embedding").cast("array<double>"), 8, 8, x, y).alias("x"))


def jersey_color_kmeans(s, d):
    """Jersey colours of crops of 4 by 4 pixels made from embeddings."""
    e = F.col("embedding").cast("array<double>")
    pixels = F.transform(F.slice(e, 1, 48), lambda x: F.least(F.greatest(F.round((x + 1) * 127.5), F.lit(0.0)), F.lit(255.0)))
    return table(s, d, "embeddings").select("vec_id", detection.jersey_colours(pixels, 4).alias("c")).select("vec_id", F.col("c.hex").alias("hex"))


def detector_udtf(s, d):
    """Detections of two registered stand-in detectors over the frames of all matches."""
    frames = table(s, d, "ball_states").select("match_id", F.col("frame_number").alias("frame_num")).dropna().distinct()
    models = detection.Detectors().add(detection.Detector("players", detection.stub_model, (0, 1), tracking=True)).add(detection.Detector("ball", detection.stub_model, (2,), 0.1))
    return models.run(frames)


def grouped_udaf_range(s, d):
    """Range of frames per player."""
    return table(s, d, "players_states").groupBy("player_id").agg((F.max("frame_number") - F.min("frame_number")).alias("frame_range"))


# -- streams --------------------------------------------------------------------------------------------------------------


def stream_state_insert(s, d, files=1000):
    """The states a stream inserts: of each player and frame, the one that came first."""
    states = stream(s, d, "players_states", files).select("id", "created_at", "player_id", "frame_number", "x1", "y1", "x2", "y2", "confidence", "timestamp")
    return stateful.drain(stateful.first_states(states), "states").drop("created_at")


def stream_state_dedupe(s, d):
    """Keys of the states that a stream inserts."""
    return stream_state_insert(s, d).select("player_id", "frame_number")


def _depth_stream(s, d, files):
    return stream(s, d, "depth_history", files).where("match_id is not null and frame_num is not null").select("id", "match_id", "frame_num", "depth", "camera_scale")


def stream_ema(s, d, files=1000):
    """The moving average of depth_ema, over a stream."""
    rows = _depth_stream(s, d, files).withColumn("x", G.inverse_depth(F.col("depth"), F.lit(1.0)))
    return stateful.drain(stateful.moving_average(rows, "match_id", "frame_num", "x", "id"), "ema", "update", ["match_id", "frame_num"]).select("match_id", "frame_num", F.round("ema", 9).alias("ema"))


def stream_gate(s, d, files=1000):
    """The gate of depth_gate, over a stream."""
    return stateful.drain(stateful.gate(_depth_stream(s, d, files), "match_id", "frame_num", "camera_scale", "id"), "gate", "update", ["match_id", "frame_num"])


def stream_windows(s, d, files=1000):
    """Events per ten minutes and type, with a watermark."""
    rows = stream(s, d, "events", files).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stateful.windowed_counts(rows, "ts", ["event_type"]).select(F.col("window.start").alias("began"), "event_type", "n")
    return stateful.drain(counts, "windows", "update", ["began", "event_type"]).select(F.date_format("began", "yyyy-MM-dd HH:mm").alias("began"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        reid_merge_map, balls_by_match, goals_by_match, players_by_match, state_by_track_frame, states_by_frame, states_by_frame_range, player_by_id_first,
        class_conf_filter, goal_conf_filter, latest_players, player_upsert, state_insert_if_absent, team_color_last_write, numbers_cascade_delete, centroids,
        track_partition_ghosts, track_summaries, color_distance, reid_candidates, reid_merged_states, reid_merged_numbers, reid_surviving_players, reid_summary,
        reid_frame_conflicts, near_frame_band, detection_report, report_boxes, recognition_frequency, average_confidence, tracking_persistence,
        report_csv_roundtrip, step_timing_stats, timing_json_roundtrip, frame_batches, frame_displacement, frame_speed, depth_ema, depth_gate,
        task_latest_state, task_step_upsert, task_cascade_delete, ball_append, goal_append, state_append, mean_colors, near_frame_rows, frame_kinematics,
        video_metadata, grid_sample, depth_constant, bbox_clamp, hip_point, vector_minmax, vector_standardize, cluster_pick, hex_color, storage_keys, label_text, enum_map,
        crop_slice, jersey_color_kmeans, detector_udtf, grouped_udaf_range, stream_state_insert, stream_state_dedupe, stream_ema, stream_gate, stream_windows,
    )
}
