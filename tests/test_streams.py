"""Streams over several micro-batches: rows in any order, copies in different files."""

import duckdb
import pytest
from conftest import same_rows

from touchline.plans import reference, reference_sql


@pytest.fixture(scope="module")
def scattered(spark, data, tmp_path_factory):
    """The tables cut into six files without regard to order, with some rows in two files."""
    d = tmp_path_factory.mktemp("scattered")
    for name in ("depth_history", "players_states", "events"):
        rows = spark.read.parquet(f"{data}/{name}.parquet")
        rows.unionByName(rows.where("pmod(xxhash64(*), 5) = 0") if name != "events" else rows.limit(0)).repartition(6).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def scattered_sql(scattered):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in ("depth_history", "players_states", "events"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{scattered}/{name}.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", ["stream_ema", "stream_gate", "stream_state_dedupe"])
def test_several_batches_equal_the_whole(spark, scattered, scattered_sql, name):
    query = reference.stream_state_insert(spark, scattered, 1).select("player_id", "frame_number") if name == "stream_state_dedupe" else reference.QUERIES[name](spark, scattered, 1)
    same_rows(query, scattered_sql.execute(reference_sql.ORACLES[name]))


def test_windows_over_several_batches(spark, scattered, scattered_sql):
    """All rows are within the watermark's reach only if files follow time; here late windows may be cut, never wrong."""
    got = {(r.began, r.event_type): r.n for r in reference.stream_windows(spark, scattered, 6).collect()}
    want = {(b, t): n for b, t, n in scattered_sql.execute(reference_sql.ORACLES["stream_windows"]).fetchall()}
    assert got == want
    late = {(r.began, r.event_type): r.n for r in reference.stream_windows(spark, scattered, 1).collect()}
    assert set(late) <= set(want) and all(n <= want[k] for k, n in late.items())


def test_rows_behind_the_horizon_are_left_out(spark, tmp_path):
    from touchline.streaming import stateful

    for i, frames in enumerate([(10, 20), (5000, 5010), (15, 4995)]):
        spark.createDataFrame([(1, f, float(f), f) for f in frames], "k int, f int, x double, id int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
    rows = spark.readStream.schema("k int, f int, x double, id int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    out = stateful.drain(stateful.moving_average(rows, "k", "f", "x", "id", horizon=100), "ema", "update", ["k", "f"]).orderBy("f").collect()
    assert [r.f for r in out] == [10, 20, 4995, 5000, 5010]
    s = 0.0
    for r in out:
        s = 0.2 * r.f + 0.8 * s
        assert r.ema == pytest.approx(s)
