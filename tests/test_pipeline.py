import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import detection
from touchline.operators.lookup import both
from touchline.operators.vectors import torso
from touchline.plans.pipeline import Pipeline, analyze
from touchline.schemas import TABLES, create_tables
from touchline.settings import SessionValues, Settings, require_files
from touchline.sources.frames import SCHEMA as FRAMES
from touchline.sources.frames import FrameSource


def boxes(spark, rows):
    return spark.createDataFrame([(1, f, c, t, x, y, x + 10, y + 10, p) for f, c, t, x, y, p in rows], detection.DETECTION)


def test_suppression(spark):
    rows = [(1, 0, 0, 0, 0, 0.9), (1, 0, 0, 1, 1, 0.8), (1, 0, 0, 50, 50, 0.3), (1, 1, 0, 1, 1, 0.2), (2, 0, 0, 1, 1, 0.1)]
    kept = sorted((r.frame_num, r.class_id, r.x1) for r in detection.suppress(boxes(spark, rows)).collect())
    assert kept == [(1, 0, 0), (1, 0, 50), (1, 1, 1), (2, 0, 1)]


def test_tracking_by_overlap(spark):
    rows = [(1, 0, 0, 0, 0, 0.9), (1, 0, 0, 100, 0, 0.9), (2, 0, 0, 102, 0, 0.9), (2, 0, 0, 2, 0, 0.9), (3, 0, 7, 500, 0, 0.9), (400, 0, 0, 2, 0, 0.9)]
    out = {(r.frame_num, r.x1): r.track_id for r in detection.track(boxes(spark, rows)).collect()}
    assert out[1, 0] == out[2, 2] and out[1, 100] == out[2, 102] and out[1, 0] != out[1, 100]
    assert out[3, 500] == 7 and out[400, 2] == 8


def test_analysis_of_a_match(spark):
    def moving_model():
        def run(b: pd.DataFrame) -> pd.DataFrame:
            n = b["frame_num"]
            one = pd.DataFrame({"match_id": b["match_id"], "frame_num": n, "class_id": 0, "track_id": 0, "x1": n % 200, "y1": 5, "x2": n % 200 + 20, "y2": 45, "confidence": 0.9})
            return pd.concat([one, one.assign(y1=300, y2=340)]).astype({"x1": "int32", "x2": "int32"})

        return run

    spark.dataSource.register(FrameSource)
    frames = spark.read.format("frames").option("match_id", 3).option("frames", 120).load()
    tables, p = analyze(spark, frames, 3, detection.Detectors().add(detection.Detector("moving", moving_model, (0,))))
    report = tables["report"].collect()
    assert sorted((r.n_states, r.persistence) for r in report) == [(120, 119), (120, 119)]
    assert [r.outcome for r in p.log_table().collect()] == ["done"] * 4 and set(p.timer.stats) == {n for n, _ in p.steps}


def pictures(spark, match, n, height=12, width=20):
    """Red frames, from number 60 on blue ones."""
    colour = lambda k: bytes([200, 20, 20] if k < 60 else [20, 20, 200]) * (height * width)
    return spark.createDataFrame([(match, k, k / 25, height, width, bytearray(colour(k))) for k in range(1, n + 1)], FRAMES)


def test_pieces_of_another_colour_do_not_merge(spark):
    def model():
        def run(b: pd.DataFrame) -> pd.DataFrame:
            n = b["frame_num"]
            one = pd.DataFrame({"match_id": b["match_id"], "frame_num": n, "class_id": 0, "track_id": 1, "x1": 2, "y1": 2, "x2": 8, "y2": 8, "confidence": 0.9})
            red = one[n < 40].assign(track_id=1), one[(n >= 40) & (n < 60)].assign(track_id=23)
            return pd.concat([*red, one[(n >= 60) & (n < 80)].assign(track_id=24), one[n >= 80].assign(track_id=25, x1=90, x2=99)])

        return run

    tables, _ = analyze(spark, pictures(spark, 5, 100), 5, detection.Detectors().add(detection.Detector("players", model, (0,), tracking=True)))
    players = {r.track_id: r for r in tables["players"].collect()}
    colour = {k: tuple(map(int, r.team_color.split(","))) if r.team_color else None for k, r in players.items()}
    assert max(abs(a - b) for a, b in zip(colour[1], (200, 20, 20), strict=True)) <= 4 and colour[23] == colour[1]
    assert max(abs(a - b) for a, b in zip(colour[24], (20, 20, 200), strict=True)) <= 4 and colour[25] is None
    assert {(r.member, r.root) for r in tables["merges"].collect()} == {(players[23].id, players[1].id)}
    assert tables["state_colours"].count() == 79


def test_balls_goals_and_two_tracking_detectors(spark):
    def model(track_id, x):
        def load():
            def run(b: pd.DataFrame) -> pd.DataFrame:
                first = b["frame"].map(lambda f: f[0]) if "frame" in b else 0  # a model's input is the picture
                return pd.DataFrame({"match_id": b["match_id"], "frame_num": b["frame_num"], "class_id": 0, "track_id": track_id, "x1": first, "y1": 2, "x2": first + x, "y2": 9, "confidence": 0.8})

            return run

        return load

    models = detection.Detectors()
    for name, kind, track_id, x in [("a", "player", 1, 5), ("b", "player", 1, 7), ("c", "player", 0, 6), ("ball", "ball", 0, 3), ("goal", "goal", 9, 11)]:
        models.add(detection.Detector(name, model(track_id, x), (0,), tracking=track_id > 0, kind=kind))
    tables, _ = analyze(spark, pictures(spark, 6, 30, 12, 250), 6, models)
    report = tables["detections_report"].collect()
    seen = {(k, x): sum(r.object_type == k and r.bbox == f"200.0, 2.0, {200 + x}.0, 9.0" for r in report) for k, x in [("player", 5), ("player", 7), ("player", 6), ("ball", 3), ("goal", 11)]}
    assert set(seen.values()) == {30} and len(report) == 150
    assert {r.track_id for r in report if r.object_type != "player"} == {0} and max(r.timestamp for r in report) == 1
    assert tables["players"].count() == 3 and tables["states"].count() == 90 and tables["balls"].count() == tables["goals"].count() == 30
    assert len(tables["detections_report"].columns) == 11


def test_detectors_suppress_by_their_own_limits(spark):
    def model():
        def run(b: pd.DataFrame) -> pd.DataFrame:
            one = pd.DataFrame({"match_id": b["match_id"], "frame_num": b["frame_num"], "class_id": 0, "track_id": 0, "x1": 0, "y1": 0, "x2": 20, "y2": 10, "confidence": 0.9})
            return pd.concat([one, one.assign(x1=6, x2=26, confidence=0.8)])  # overlap 14 / 26 = 0.54

        return run

    models = detection.Detectors()
    for name, kind, more in (("ball", "ball", {}), ("goal", "goal", {}), ("player", "player", {}), ("strict", "player", {"most_overlap": 0.5})):
        models.add(detection.Detector(name, model, (0,), kind=kind, **more))
    found = models.run_named(pictures(spark, 7, 1)).groupBy("detector").count().collect()
    assert {r.detector: r["count"] for r in found} == {"ball": 1, "goal": 1, "player": 2, "strict": 1}


def test_goal_rows_are_filtered(spark, data):
    from touchline.plans import reference
    from touchline.sources.files import goal_frames

    want = goal_frames(spark, data).where("coalesce(confidence, 0.3) >= 0.15").select("id").distinct().count()
    got = reference.QUERIES["goal_conf_filter"](spark, data).collect()
    assert 0 < want == len({r.id for r in got}) and {r["class"] for r in got} == {"goal"}


def test_failing_steps_are_tried_again(spark):
    calls = []

    def shaky(t):
        calls.append(1)
        if len(calls) < 2:
            raise RuntimeError("once")
        return {"x": 1}

    p = Pipeline(spark, 1, attempts=2).add("shaky", shaky)
    assert p.run({})["x"] == 1 and [x[2] for x in p.log] == ["failed", "done"]
    with pytest.raises(ZeroDivisionError):
        Pipeline(spark, 1).add("bad", lambda t: 1 / 0).run({})


def test_tables_settings_values(spark, tmp_path, monkeypatch):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS touch LOCATION '{tmp_path}/touch'")
    create_tables(spark, "touch")
    create_tables(spark, "touch", drop_existing=True)
    assert {t.name for t in spark.catalog.listTables("touch")} == set(TABLES)
    spark.sql("DROP DATABASE touch CASCADE")
    monkeypatch.setenv("TOUCHLINE_BATCH_SIZE", "8")
    assert Settings.load().batch_size == 8 and Settings.load(spark).attempts == 2
    v = SessionValues(spark)
    v.update({"a": 1, "b": "x"})
    assert (v.get("a"), v.get("b"), v.get("c", "d")) == ("1", "x", "d")
    v.reset()
    assert v.get("a") is None
    with pytest.raises(FileNotFoundError):
        require_files(str(tmp_path / "none"))


def test_small_helpers(spark):
    assert torso((10, 20, 90, 180), 200, 40) == (20, 50, 80, 120)
    df = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert df.where(both(F.col("a") == 1, F.col("b") == 2)).count() == 1 and df.where(both(F.col("a") == 1, F.col("b") == 2, compat=True)).count() == 2
