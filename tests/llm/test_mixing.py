import numpy as np
from pyspark.sql import functions as F

from touchline.llm.mixing import document_sizes, plan_mixes, source_name
from touchline.sources.tables import table

TARGETS = "mix_name string, corpus_ratio double, source string, target_weight double, max_repeats int"


def test_source_spellings(spark):
    df = spark.createDataFrame([(s,) for s in (" Fan-Comments", "fan_comments ", "FAN COMMENTS", "", " ", None)], "s string")
    assert [r[0] for r in df.select(source_name(F.col("s"))).collect()] == ["fan_comments"] * 3 + [None] * 3


def test_targets_caps_and_reports(spark):
    docs = [(i, "word " * (1 + i % 40), "a" if i % 3 else "B ", "x") for i in range(900)] + [(10_000, None, "a", "x"), (10_001, "", "b", "x"), (10_002, "text", None, "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, rate string")
    targets = spark.createDataFrame(
        [("m", 0.5, "a", 1.0, 1), ("m", 0.5, "b", 2.0, 3), ("big", 3.0, "a", 1.0, 2), ("big", 3.0, "gone", 1.0, 9), ("none", 0.5, "a", 0.0, 1), (None, 1.0, "a", 1.0, 1), ("m", 0.5, None, 1.0, 1), ("w", 0.2, "a", None, 2), ("w", 0.2, "b", 3.0, None)],
        TARGETS,
    )
    mix, shares = plan_mixes(docs, targets)
    mix = mix.collect()
    s = {(r.mix_name, r.source): r for r in shares.collect()}
    assert len(s) == 7 and len({(r.mix_name, r.doc_id) for r in mix}) == len(mix)
    for key in (("m", "a"), ("m", "b"), ("w", "b")):
        assert abs(s[key].actual_tokens - s[key].target_tokens) <= 45, s[key]
    assert max(r.copies for r in mix if r.mix_name == "m" and r.source == "a") == 1
    assert max(r.copies for r in mix if r.mix_name == "m" and r.source == "b") <= 3
    assert s["big", "a"].exhausted and {r.copies for r in mix if (r.mix_name, r.source) == ("big", "a")} == {2}
    assert s["big", "gone"].exhausted and s["big", "gone"].actual_tokens == 0
    assert s["none", "a"].actual_tokens == 0 and s["w", "a"].actual_tokens == 0
    assert abs(sum(r.actual_share for k, r in s.items() if k[0] == "m") - 1) < 1e-9
    assert all(r.n_tokens > 0 for r in mix)


def solved(sizes, target, cap):
    """Rates of least relative entropy to one copy each, with the target's tokens: bisection on the tilt."""
    x = np.asarray(sizes, float)
    low, high = -1.0, 1.0
    rate = lambda t: np.minimum(cap, np.exp(np.minimum(t * x, 700)))
    while (rate(low) * x).sum() > target:
        low *= 2
    while (rate(high) * x).sum() < target:
        high *= 2
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if (rate(mid) * x).sum() < target else (low, mid)
    return rate(low)


def test_rates_equal_an_independent_solution(spark, data):
    """Every line's rates, those at their cap and those of shrinking and growing sources; drawn tokens near the target."""
    documents, targets = table(spark, data, "documents"), table(spark, data, "mix_targets")
    mix, shares = plan_mixes(documents, targets)
    sizes = {}
    for r in document_sizes(documents).where("n_tokens > 0 and source is not null").collect():
        sizes.setdefault(r.source, {})[r.doc_id] = r.n_tokens
    got = {}
    for r in mix.collect():
        got.setdefault((r.mix_name, r.source), {})[r.doc_id] = r
    shrunk = grown = 0
    for s in shares.collect():
        if s.exhausted or s.target_tokens <= 0:
            continue
        own = sizes[s.source]
        want = dict(zip(own, solved(list(own.values()), s.target_tokens, s.max_repeats), strict=True))
        rows = got.get((s.mix_name, s.source), {})
        assert all(abs(r.rate - want[i]) <= 1e-5 * max(want[i], 1e-3) for i, r in rows.items()), s
        assert all(want[i] < r.copies + 1 and r.copies <= min(want[i] + 1, s.max_repeats) for i, r in rows.items())
        shrunk, grown = shrunk + (s.target_tokens < sum(own.values())), grown + (s.target_tokens > sum(own.values()))
        # one more or one less of some document of intermediate rate would not come nearer
        assert abs(s.actual_tokens - s.target_tokens) <= max(own.values()) / 2 + 1e-6, s
        assert len({round(r.rate, 9) for r in rows.values()}) > 1 or len({r.n_tokens for r in rows.values()}) <= 1
    assert shrunk and grown


def test_rates_near_their_cap(spark):
    """A target just below all that a source may give, where nearly all rates stand at their cap."""
    docs = spark.createDataFrame([(i, "word " * (1 + i % 7), "a") for i in range(200)], "doc_id long, text string, source string")
    own = {r.doc_id: r.n_tokens for r in document_sizes(docs).collect()}
    total = sum(own.values())
    mix, shares = plan_mixes(docs, spark.createDataFrame([("m", 2.999, "a", 1.0, 3), ("n", 0.0005, "a", 1.0, 3)], TARGETS))
    want = dict(zip(own, solved(list(own.values()), 2.999 * total, 3), strict=True))
    assert all(abs(r.rate - want[r.doc_id]) < 1e-5 for r in mix.where("mix_name = 'm'").collect())
    assert all(abs(r.actual_tokens - r.target_tokens) <= 7 for r in shares.collect())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    mix, shares = plan_mixes(docs, spark.createDataFrame([("m", 0.5, "a", 1.0, 1)], TARGETS))
    assert mix.count() == 0 and shares.first().actual_tokens == 0
