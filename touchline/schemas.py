"""Schemas of the match tables, and their creation as managed tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

_ID = "id bigint, created_at timestamp, updated_at timestamp"
_BOX = "x1 double, y1 double, x2 double, y2 double"
_FRAME = "frame_number int, timestamp int, confidence double"
_MOVEMENT = (
    "dx double, dy double, dx_meters double, dy_meters double, distance_meters double, delta_x double, delta_y double, "
    "acceleration double, ax double, ay double, speed_kmh double, vx double, vy double"
)

TABLES = {
    "players": f"{_ID}, match_id int, track_id int, team_id int, team_color string, goals int, shirt_number int, crop_path string",
    "players_numbers": f"{_ID}, player_id bigint, number int, confidence double, frame_number int",
    "players_states": f"{_ID}, player_id bigint, is_goal boolean, has_ball boolean, ball_x double, ball_y double, ball_id bigint, {_BOX}, {_FRAME}, {_MOVEMENT}",
    "ball_states": f"{_ID}, match_id int, {_BOX}, {_FRAME}, {_MOVEMENT}",
    "goals": f"{_ID}, match_id int, {_BOX}, {_FRAME}",
    "depth_history": f"{_ID}, match_id int, frame_num int, timestamp int, depth double, pixels_to_meters double, camera_scale double, constant double",
    "tasks": "id string, created_at timestamp, updated_at timestamp, completed_at timestamp, match_id int, video_name string, general_state string, user_id int",
    "task_steps": f"{_ID}, completed_at timestamp, step_number int, name string, message string, state string, task_id string",
    "track_summaries": (
        "player_id bigint, tracker_id int, frame_start int, frame_end int, detection_count int, avg_color string, "
        "first_cx double, first_cy double, last_cx double, last_cy double"
    ),
}


def create_tables(spark: SparkSession, database: str = "default", drop_existing: bool = False) -> None:
    for name, columns in TABLES.items():
        if drop_existing:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
