from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.operators.intervals import merge_intervals, run_bitmaps, set_and_clear_runs, union_bitmaps

SCHEMA = "player_id long, frame_start int, frame_end int, runs string, key int"


def brute(rows):
    out = []
    for p in {r[0] for r in rows if r[0] is not None}:
        covered = set()
        for q, a, b in rows:
            if q == p and a is not None and b is not None and a <= b:
                covered |= set(range(a, b + 1))
        runs = []
        for x in sorted(covered):
            if runs and x == runs[-1][1] + 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        out += [(p, "period", a, b) for a, b in runs]
        out += [(p, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])]
    return sorted(out)


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


bound = st.one_of(st.none(), st.integers(-40, 120))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(1, 2)), bound, bound), max_size=15))
def test_equals_brute_force(spark, rows):
    got = sorted(map(tuple, merge_intervals(make(spark, rows), width=8).collect()))
    assert got == brute(rows)


def test_long_and_nested(spark):
    rows = [(1, 0, 200_000), (1, 5, 10), (1, 200_001, 200_002), (1, 400_000, 400_000)]
    got = sorted(map(tuple, merge_intervals(make(spark, rows)).collect()))
    assert got == [(1, "gap", 200_003, 399_999), (1, "period", 0, 200_002), (1, "period", 400_000, 400_000)]


def test_union_of_days(spark):
    a, b = [(1, 0, 9), (2, 5, 6)], [(1, 10, 30), (2, 8, 8)]
    both = union_bitmaps(*[run_bitmaps(make(spark, r), "player_id", "frame_start", "frame_end", 8) for r in (a, b)], width=8)
    got = sorted(map(tuple, set_and_clear_runs(both, "player_id", "frame_start", "frame_end", 8).collect()))
    assert got == brute(a + b)
