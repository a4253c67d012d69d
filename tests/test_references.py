from datetime import datetime, timedelta

from touchline.operators.references import Reference, dictionary, orphan_references, orphan_report

T0 = datetime(2025, 1, 1)
REF = "id long, created_at timestamp, a long, b long, period string, word int"


def at(s):
    return None if s is None else T0 + timedelta(seconds=s)


def run(spark, refs, parents):
    r = spark.createDataFrame([(i, at(t), a, b, "x", 1) for i, t, a, b in refs], REF)
    p = {n: spark.createDataFrame([(i, at(t), "y") for i, t in rows], "id long, created_at timestamp, bits string") for n, rows in parents.items()}
    return orphan_references([Reference("r", r, (("a", "p"), ("b", "q")))], p)


def test_missing_late_and_defaults(spark):
    refs = [(1, 10, 5, None), (2, 10, 6, -1), (3, 10, 7, 8), (3, 10, 7, 8), (4, None, 7, 9), (5, 0, 5, 8), (6, 10, 70, 9)]
    parents = {"p": [(5, 4), (5, 20), (7, 11), (70, 10)], "q": [(8, 5), (9, None), (-1, 3)]}
    got = sorted((r.ref_field, r.ref_id, r.kind) for r in run(spark, refs, parents).collect())
    assert got == [("a", 2, "missing"), ("a", 3, "late"), ("a", 5, "late"), ("b", 5, "late")]


def test_word_borders(spark):
    refs = [(k, 100, k, None) for k in (-65, -64, -1, 0, 63, 64, 127, 128, 2**40)]
    got = {r.ref_id for r in run(spark, refs, {"p": [(k, 0) for k in (-64, 0, 64, 2**40)], "q": []}).collect()}
    assert got == {-65, -1, 63, 127, 128}


def test_empty_tables(spark):
    assert run(spark, [], {"p": [], "q": []}).count() == 0
    assert run(spark, [(1, 0, 1, 1)], {"p": [], "q": []}).count() == 2


def test_report(spark):
    out = orphan_report(run(spark, [(1, 0, 1, None), (2, 90_000, 2, None), (3, None, 3, None)], {"p": [], "q": []})).collect()
    assert sorted((str(r.period)[:10], r.n_orphans) for r in out) == [("2025-01-01", 1), ("2025-01-02", 1), ("None", 1)]


def test_dictionary(spark):
    d = dictionary(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), spark.createDataFrame([("b",), ("c",)], "z string"), buckets=2).collect()
    assert sorted(r.key for r in d) == ["a", "b", "c"] and len({r.code for r in d}) == 3


def test_keys_of_text(spark):
    refs = spark.createDataFrame([(1, at(10), "a"), (2, at(10), "b"), (3, at(10), "c"), (4, at(10), None)], "id long, created_at timestamp, k string")
    parents = spark.createDataFrame([("a", at(0)), ("c", at(20))], "id string, created_at timestamp")
    got = orphan_references([Reference("r", refs, (("k", "p"),))], {"p": parents}).collect()
    assert sorted((r.ref_id, r.kind) for r in got) == [(2, "missing"), (3, "late")]
