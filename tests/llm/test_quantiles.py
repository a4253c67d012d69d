import numpy as np
from pyspark.sql import functions as F

from touchline.llm.quantiles import RANK_ERROR, merge_sketches, read_quantiles, sketches, speed_percentiles


def test_rank_error_and_merging(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.lognormal(1, 1, 60_000), rng.normal(20, 1, 40_000)])
    df = spark.createDataFrame([(i % 7, float(v)) for i, v in enumerate(x)], "day int, v double").withColumn("k", F.lit(1)).repartition(8)
    parts = sketches(df, ["k", "day"], "v", F.lit(True))
    row = read_quantiles(merge_sketches(parts, ["k"]), ["k"]).first()
    assert row.n == len(x) and row.rank_error == RANK_ERROR
    for p in (1, 5, 25, 50, 75, 95, 99):
        assert abs((x <= row[f"p{p}"]).mean() - p / 100) < 2 * RANK_ERROR


def test_speed_percentiles(spark):
    nan = float("nan")
    rows = [(1, f, float(f), "x") for f in range(1, 101)] + [(1, 5, 5.0, "x")] * 3
    rows = [r for r in rows if r[2] <= 60] + [(1, 200, None, "x"), (1, 201, 0.0, "x"), (1, 202, nan, "x"), (1, 203, -1.0, "x"), (1, 204, float("inf"), "x"), (2, 1, None, "x"), (None, 1, 5.0, "x"), (3, None, 7.0, "x")]
    states = spark.createDataFrame(rows, "player_id long, frame_number int, speed_kmh double, level string")
    players = spark.createDataFrame([(1, 9, "y"), (1, 9, "y"), (2, 9, "y"), (3, None, "y")], "id long, match_id int, n string")
    out = {(r.level, r.group_id): r for r in speed_percentiles(states, players).collect()}
    one = out["player", 1]
    assert (one.n, one.n_null, one.n_unsound, one.rank_error) == (60, 1, 4, 0.0) and one.p50 == 30.0
    assert out["player", 2].p50 is None and out["match", 9].n == 60 and out["match", None].p50 == 7.0
    assert speed_percentiles(states.limit(0), players).count() == 0


def test_ranks_of_the_given_table(spark, data):
    """Every percentile of every player and match against exact ranks."""
    from touchline.sources.tables import table

    states, players = table(spark, data, "players_states"), table(spark, data, "players")
    rows = states.where("player_id is not null and speed_kmh > 0 and speed_kmh <= 60").select("player_id", "frame_number", "speed_kmh").distinct()
    matches = {r.id: r.match_id for r in players.select("id", "match_id").distinct().collect()}
    values: dict = {}
    for r in rows.collect():
        values.setdefault(("player", r.player_id), []).append(r.speed_kmh)
        values.setdefault(("match", matches.get(r.player_id)), []).append(r.speed_kmh)
    compacted = 0
    for r in speed_percentiles(states, players).collect():
        x = np.sort(values.get((r.level, r.group_id), []))
        assert r.n == len(x)
        compacted += r.rank_error > 0
        for p in (1, 5, 25, 50, 75, 95, 99) if len(x) else ():
            low, high = np.searchsorted(x, r[f"p{p}"], "left") / len(x), np.searchsorted(x, r[f"p{p}"], "right") / len(x)
            assert low - 2 * r.rank_error - 1 / len(x) <= p / 100 <= high + 2 * r.rank_error + 1 / len(x)
    assert compacted > 0
