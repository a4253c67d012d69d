import numpy as np
import pytest

from touchline.operators.grid import regular_grid

SCHEMA = "player_id long, frame_number int, dx_meters double, dy_meters double, _shard string, _v0 int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_bridges_between_observed_endpoints(spark):
    out = {r.grid_frame: r for r in regular_grid(frame(spark, [(1, 0, 0.0, 5.0), (1, 10, 2.0, 5.0), (1, 100, 9.0, 5.0)])).collect()}
    assert sorted(out) == [0, 25, 50, 75, 100]
    assert [out[f].status for f in sorted(out)] == ["observed", "filled", "filled", "filled", "observed"]
    assert out[0].dx_meters == 1.0 and out[0].n_readings == 2
    assert 1.0 < out[25].dx_meters < out[50].dx_meters < out[75].dx_meters < 9.0
    assert out[50].dy_meters == pytest.approx(5.0, abs=1e-6)


def test_unusable_and_repeated_rows(spark):
    nan = float("nan")
    rows = [(1, 0, 1.0, 1.0)] * 3 + [(1, 30, None, 2.0), (1, 60, nan, 2.0), (1, 90, 3.0, 3.0), (None, 5, 1.0, 1.0), (2, None, 1.0, 1.0), (3, 7, nan, nan), (3, 60, nan, 1.0), (4, -1, 1.0, 1.0)]
    out = {(r.player_id, r.grid_frame): r for r in regular_grid(frame(spark, rows)).collect()}
    assert out[1, 0].n_readings == 1
    assert out[1, 25].status == "filled"  # a null reading isn't usable
    assert out[1, 50].status == "observed" and out[1, 50].dx_meters is not None
    assert out[3, 25].status == "marked" and out[3, 25].dx_meters is None
    assert (4, -25) in out
    assert {k[0] for k in out} == {1, 3, 4}


def test_empty(spark):
    assert regular_grid(frame(spark, [])).count() == 0


def test_gaps_over_many_shards(spark):
    out = regular_grid(frame(spark, [(1, 0, 0.0, 0.0), (1, 25 * 9000, 1.0, 1.0)]))
    assert out.count() == 9001
    assert out.where("status = 'filled'").agg({"dx_meters": "max"}).first()[0] <= 1.0 + 0.5


def test_shards_beyond_one_arrow_batch(spark):
    """A player with more shards than an Arrow batch has rows: all batches but the first hold no sums to solve."""
    at, batch = [0, 2500, 3000, 6400, 7000, 9600, 12800, 14400], "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [(1, f, f / 100.0, float(np.sin(f))) for f in at]
    cells = lambda: sorted(tuple(r) for r in regular_grid(frame(spark, rows)).collect())
    whole, before = cells(), spark.conf.get(batch)
    spark.conf.set(batch, 2)
    try:
        parts = cells()
    finally:
        spark.conf.set(batch, before)
    assert len(whole) == 14400 // 25 + 1
    assert {r[1] for r in whole if r[3] == "filled"} == set(range(0, 14401, 25)) - set(at)
    assert [r[:4] for r in parts] == [r[:4] for r in whole]
    assert np.allclose([r[4:] for r in parts], [r[4:] for r in whole], rtol=1e-9, atol=1e-9)


def test_held_out_accuracy(spark):
    """A seasonal movement with a trend is predicted better inside long gaps than by straight lines."""
    rng = np.random.default_rng(3)
    t = np.arange(0, 25 * 600, 25)
    path = lambda t: 10 * np.sin(2 * np.pi * t / 1500) + t / 1000
    hidden = np.isin((t // 25) % 45, np.arange(10, 35)) & (t > 0) & (t < t[-1])
    rows = [(1, int(f), float(path(f) + rng.normal(0, 0.05)), 0.0) for f in t[~hidden]]
    out = {r.grid_frame: r.dx_meters for r in regular_grid(frame(spark, rows)).collect()}
    error = np.array([out[int(f)] - path(f) for f in t[hidden]])
    straight = np.interp(t[hidden], t[~hidden], path(t[~hidden])) - path(t[hidden])
    assert np.sqrt((error**2).mean()) < 0.2 * np.sqrt((straight**2).mean())
