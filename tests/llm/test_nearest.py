import random

from touchline.llm.nearest import match_nearest

LEFT, RIGHT = "id long, m int, t int, entity string, _b int", "id long, m int, u int, lo string, r_id int"


def run(spark, left, right, tolerance=75):
    a = spark.createDataFrame([(*r, "x", 1) for r in left], LEFT)
    b = spark.createDataFrame([(*r, "x", 1) for r in right], RIGHT)
    return {r.left_id: (r.right_id, r.distance) for r in match_nearest(a, b, "m", "t", "u", "id", "id", tolerance).collect()}


def brute(left, right, tolerance):
    out = {}
    for i, m, t in left:
        near = [(abs(u - t), u, j) for j, n, u in right if None not in (m, t, n, u) and n == m and abs(u - t) <= tolerance]
        if near:
            _, u, j = min(near)
            out[i] = (j, u - t)
    return out


def test_random_against_brute_force(spark):
    rnd = random.Random(2)
    for tolerance, span in ((3, 60), (75, 4000), (0, 20)):
        left = [(i, rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, *[rnd.randint(-span, span)] * 9])) for i in range(300)]
        right = [(rnd.randint(1, 10**6), rnd.choice([1, 1, 2, None]), rnd.choice([None, *[rnd.randint(-span, span)] * 9])) for _ in range(120)]
        assert run(spark, left + left[:20], right + right[:9], tolerance) == brute(left, right, tolerance)


def test_ties_and_empty(spark):
    assert run(spark, [(1, 1, 10)], [(5, 1, 5), (6, 1, 15), (9, 1, 5)]) == {1: (5, -5)}
    assert run(spark, [(1, 1, 10)], []) == {} and run(spark, [], [(1, 1, 1)]) == {}
