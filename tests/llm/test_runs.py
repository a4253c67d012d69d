import random

from touchline.llm.runs import WIDTH, agglomerate, collapse_runs

SCHEMA = "player_id long, frame_number int, has_ball boolean, key string, _shard int"


def brute(rows, max_gap=50, max_span=15):
    by = {}
    for p, t, v in rows:
        if None not in (p, t, v):
            by.setdefault(p, {})[t] = max(v, by.get(p, {}).get(t, False))
    out = []
    for p, events in by.items():
        ts = sorted(events)
        v = [events[t] for t in ts]
        s = list(v)
        for i in range(1, len(ts) - 1):
            if v[i - 1] != v[i] != v[i + 1] and ts[i + 1] - ts[i - 1] <= max_span:
                s[i] = v[i - 1]
        start = 0
        for i in range(1, len(ts) + 1):
            if i == len(ts) or s[i] != s[i - 1] or ts[i] - ts[i - 1] > max_gap:
                out.append((p, float(s[start]), ts[start], ts[i - 1], i - start))
                start = i
    return sorted(out)


def run(spark, rows, **more):
    return sorted(map(tuple, collapse_runs(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **more).collect()))


def test_random_against_brute_force(spark):
    rnd = random.Random(4)
    rows, t = [], {1: -WIDTH, 2: 0, 3: WIDTH - 40}
    for _ in range(2500):
        p = rnd.choice([1, 1, 1, 2, 3])
        t[p] += rnd.choice([1, 2, 3, 7, 8, 14, 50, 51])
        rows.append((p, t[p], rnd.random() < 0.5))
    rows += rows[:50] + [(None, 1, True), (1, None, True), (1, 5, None)]
    assert run(spark, rows) == brute(rows)


def test_borders_and_empty(spark):
    rows = [(1, WIDTH - 2, True), (1, WIDTH - 1, False), (1, WIDTH, True), (1, WIDTH + 40, True), (1, 3 * WIDTH, True)]
    assert run(spark, rows) == brute(rows) == [(1, 1.0, WIDTH - 2, WIDTH + 40, 4), (1, 1.0, 3 * WIDTH, 3 * WIDTH, 1)]
    assert run(spark, []) == []


def test_most_similar_neighbours_first():
    runs = agglomerate([0, 1, 2, 3, 4], [0.0, 0.3, 0.5, 5.0, 5.0], 10, 0.4)
    assert [(a, b, n) for a, b, n, _ in runs] == [(0, 2, 3), (3, 4, 2)]  # 0.3 and 0.5 first, whose mean is just within 0.4 of 0
    assert agglomerate([0, 100], [1.0, 1.0], 50, 0.0) == [(0, 0, 1, 1.0), (100, 100, 1, 1.0)]
    near = agglomerate([0, 1, 2], [0.0, 0.25, 0.4], 10, 0.3)
    assert near[0][:3] == (0, 0, 1) and near[1][:3] == (1, 2, 2)  # 0.25 joins 0.4 first, whose mean is too far from 0


def test_similar_values_equal_the_whole_sequence(spark):
    """Order of merges matters here: pieces over any number of shards must give what the whole sequence gives."""
    rnd = random.Random(8)
    rows, t = [], {1: -3 * WIDTH, 2: 0, 3: WIDTH - 40}
    for _ in range(4000):
        p = rnd.choice([1, 1, 1, 2, 3])
        t[p] += rnd.choice([1, 2, 3, 7, 8, 14, 50, 51] + [60_000] * (rnd.random() < 0.005))
        rows.append((p, t[p], rnd.gauss(0, 1)))
    rows += [(4, i, round(i / 100, 2)) for i in range(WIDTH - 30, WIDTH + 30)]  # one piece over a border
    rows += rows[:20] + [(None, 1, 1.0), (1, None, 1.0), (1, 5, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "player_id long, frame_number int, v double, key string, _shard int")
    by = {}
    for p, at, v in rows:
        if None not in (p, at, v):
            by.setdefault(p, {})[at] = max(v, by.get(p, {}).get(at, v))
    for distance in (0.3, 1.5):
        got = sorted(map(tuple, collapse_runs(df, value="v", max_span=0, max_distance=distance).collect()))
        want = sorted((p, m, a, b, n) for p, e in by.items() for a, b, n, m in agglomerate(sorted(e), [e[x] for x in sorted(e)], 50, distance))
        assert got == want and len(want) > 100
    assert collapse_runs(df.limit(0), value="v", max_distance=1.0).count() == 0
