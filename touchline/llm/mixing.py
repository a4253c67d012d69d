"""Mixing sources to target shares: entropy balancing of document rates, rounded into copies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.tokens import encode_corpus
from touchline.session import written

#: Newton steps after which an unsolved dual is an error; a bracket makes each step at worst a bisection.
STEPS = 80
TOLERANCE = 1e-10
#: Bins of one pass of the rounding threshold's search, and the most passes: 4096^5 exceeds the hash's 2^40 places.
BINS = 4096
PASSES = 5
#: Most lines of targets, which come to the driver.
MOST_LINES = 10_000


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, hyphens and blanks as underscores; blank is null."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"[\s ]+", " "))), r"[\s-]+", "_")
    return F.when(name != "", name)


def document_sizes(documents: DataFrame, **encoding) -> DataFrame:
    """doc_id, source (one spelling), n_tokens of every document, written once to the shared folder."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return written(encode_corpus(texts, carry=["source"], **encoding).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens")), "sizes")


class _Lines:
    """The lines (mix, source) of a plan, with what is known of each so far."""

    def __init__(self, spark, lines: list[dict]):
        self.spark, self.lines = spark, lines

    def __iter__(self):
        return iter(self.lines)

    def frame(self, *names: str) -> DataFrame:
        rows = [(t["mix_name"], t["source"], *(None if t[n] is None else float(t[n]) for n in names)) for t in self.lines]
        return self.spark.createDataFrame(rows, ", ".join(["mix_name string", "source string", *(f"{n} double" for n in names)]))


def _rate() -> Column:
    tilted = F.exp(F.least(F.col("tilt") * F.col("n_tokens") / F.col("mean"), F.lit(700.0)))
    return F.coalesce(F.col("fixed"), F.least(F.col("cap"), tilted))


def _solve(lines: _Lines, histogram: DataFrame) -> None:
    """Newton's method on the convex dual of each line: the tilt with which the expected tokens equal the target.

    The dual's gradient, the tokens missing, falls steadily in the tilt, with or without rates at their cap, so it is
    bracketed; a step that leaves the bracket, or meets a vanishing Hessian, is replaced by the bracket's middle. Steps
    are taken on the logarithm of the tokens. A step of all lines sums gradient and Hessian over the histogram of sizes.
    """
    live = [t for t in lines if t["fixed"] is None]
    for t in live:
        t["low"], t["high"] = -float("inf"), float("inf")
        t["tilt"] = float(np.log(t["tokens"] / (t["mean"] * t["docs"]))) * t["mean"] ** 2 / t["square"]
    for _ in range(STEPS):
        if not live:
            return
        x, r = F.col("n_tokens") / F.col("mean"), _rate()
        free = F.when(r < F.col("cap"), r).otherwise(0.0)
        sums = {
            (s["mix_name"], s["source"]): s
            for s in histogram.join(F.broadcast(_Lines(lines.spark, live).frame("cap", "mean", "fixed", "tilt")), "source")
            .groupBy("mix_name", "source")
            .agg(F.sum(r * x * F.col("n")).alias("g"), F.sum(free * x * x * F.col("n")).alias("h"))
            .collect()
        }
        still = []
        for t in live:
            s, want = sums[t["mix_name"], t["source"]], t["tokens"] / t["mean"]
            if abs(s["g"] - want) <= TOLERANCE * want:
                continue
            t["low" if s["g"] < want else "high"] = t["tilt"]
            step = np.log(want / s["g"]) * s["g"] / s["h"] if s["g"] > 0 and s["h"] > 0 else np.copysign(np.inf, want - s["g"])
            new = t["tilt"] + float(np.clip(step, -4.0 - abs(t["tilt"]), 4.0 + abs(t["tilt"])))
            if not t["low"] < new < t["high"]:
                new = (t["low"] + t["high"]) / 2
            if new in (t["low"], t["high"]):
                continue  # the bracket has no number left inside: solved as far as numbers go
            t["tilt"] = new
            still.append(t)
        live = still
    if live:
        raise ArithmeticError(f"dual of {live[0]['mix_name']}, {live[0]['source']} not solved within {STEPS} steps")


def _draw(sizes: DataFrame, lines: _Lines) -> DataFrame:
    """Documents with rate, whole copies and the position `v` that decides on one more: it is drawn if v < shift."""
    u = F.pmod(F.xxhash64(F.lit("mix"), "mix_name", "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rows = sizes.where("n_tokens > 0").join(F.broadcast(lines.frame("cap", "mean", "fixed", "tilt")), "source").withColumn("rate", _rate()).withColumn("whole", F.floor("rate"))
    return rows.withColumn("v", F.when(F.col("fixed").isNull() & (F.col("whole") < F.col("cap")), u - (F.col("rate") - F.col("whole"))))


def _shifts(sizes: DataFrame, lines: _Lines) -> None:
    """Per line, the shift of the rounding threshold with which the drawn tokens come nearest the target.

    Tokens by bins of v, first of [-1, 1), then of the bin in which they pass the target, until that bin holds a single
    document (or copies of it): it is drawn if that comes nearer to the target.
    """
    for t in lines:
        t["lo"], t["width"], t["base"], t["shift"] = -1.0, 2.0, 0.0, None
    whole = _draw(sizes, lines).groupBy("mix_name", "source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("n"))
    drawn = {(r["mix_name"], r["source"]): float(r["n"]) for r in whole.collect()}
    for t in lines:
        t["base"] = drawn.get((t["mix_name"], t["source"]), 0.0)
        if t["fixed"] is not None:
            t["shift"] = -1.0
    for _ in range(PASSES):
        live = [t for t in lines if t["shift"] is None]
        if not live:
            return
        for t in live:
            t["missing"] = t["tokens"] - t["base"]
        edges = _Lines(lines.spark, live).frame("lo", "width", "missing")
        at = F.floor((F.col("v") - F.col("lo")) / F.col("width") * BINS)
        w = Window.partitionBy("mix_name", "source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        passing = (
            _draw(sizes, lines)
            .where("v is not null")
            .join(F.broadcast(edges), ["mix_name", "source"])
            .withColumn("bin", at)
            .where((F.col("bin") >= 0) & (F.col("bin") < BINS))
            .groupBy("mix_name", "source", "bin")
            .agg(F.sum("n_tokens").alias("n"), F.countDistinct("v").alias("places"), F.first("missing").alias("missing"))
            .withColumn("upto", F.sum("n").over(w))
            .where("upto > missing")
            .groupBy("mix_name", "source")
            .agg(F.min_by(F.struct("bin", "n", "upto", "places"), "bin").alias("b"))
            .collect()
        )
        found = {(r["mix_name"], r["source"]): r["b"] for r in passing}
        for t in live:
            b = found.get((t["mix_name"], t["source"]))
            if b is None:  # all of them together don't pass the target
                t["shift"] = t["lo"] + t["width"]
                continue
            step = t["width"] / BINS
            before = b["upto"] - b["n"]
            if b["places"] == 1:
                t["shift"] = t["lo"] + (b["bin"] + (1 if b["upto"] - t["missing"] < t["missing"] - before else 0)) * step
            t["lo"], t["width"], t["base"] = t["lo"] + b["bin"] * step, step, t["base"] + float(before)
    for t in lines:
        t["shift"] = t["lo"] if t["shift"] is None else t["shift"]


def plan_mixes(documents: DataFrame, targets: DataFrame, **encoding) -> tuple[DataFrame, DataFrame]:
    """Documents with their copies in each mix, and the shares reached.

    The size of a mix is corpus_ratio times the tokens of all documents, and a source's target its share of the summed
    weights of the mix. The rates of a source's documents minimise the relative entropy to one copy each, subject to
    the target in tokens and to at most max_repeats: they are tilted exponentially in the document's size, so a source
    that must shrink gives up long documents first, and one that must grow repeats them first. Rates are rounded into
    copies by a hash of (mix, document) against a threshold that is set so that the drawn tokens come as near to the
    target as one document lets them.

    First result: mix_name, source, doc_id, n_tokens, rate, copies (at least 1). Second: mix_name, source,
    target_share, actual_share, target_tokens, actual_tokens, n_documents (drawn), n_copies, max_repeats, exhausted.
    A source that can't reach its target within max_repeats gives all it may, and is reported as exhausted; the targets
    of the others stay. A source without documents is reported with zeros. Documents without tokens or source, or of
    a source that a mix doesn't name, aren't drawn for it but count in the size of the corpus. Targets with a null
    mix or source are left out, null weights and ratios count as 0, null max_repeats as 1; repeated lines of a mix and
    source add up their weights and take the larger max_repeats.

    Only the lines of `targets` (a configuration; more than MOST_LINES is an error) and their sums come to the driver.
    """
    spark = documents.sparkSession
    sizes = document_sizes(documents, **encoding)
    histogram = written(sizes.where("source is not null and n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "histogram")
    corpus = float(sizes.agg(F.sum("n_tokens")).first()[0] or 0)
    have = {r["source"]: r for r in histogram.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum(F.col("n") * F.col("n_tokens").cast("double") ** 2).alias("squares")).collect()}
    lines = (
        targets.select("mix_name", source_name(F.col("source")).alias("source"), "corpus_ratio", F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"))
        .where("mix_name is not null and source is not null")
        .groupBy("mix_name", "source")
        .agg(F.sum("w").alias("w"), F.max("cap").alias("cap"), F.max(F.coalesce("corpus_ratio", F.lit(0.0))).alias("ratio"))
        .limit(MOST_LINES + 1)
        .collect()
    )
    if len(lines) > MOST_LINES:
        raise ValueError(f"more than {MOST_LINES} lines of targets")
    weights: dict[str, float] = {}
    ratios: dict[str, float] = {}
    for r in lines:
        weights[r["mix_name"]] = weights.get(r["mix_name"], 0.0) + r["w"]
        ratios[r["mix_name"]] = max(ratios.get(r["mix_name"], 0.0), r["ratio"])
    wanted = []
    for r in sorted(lines, key=lambda r: (r["mix_name"], r["source"])):
        share = r["w"] / weights[r["mix_name"]] if weights[r["mix_name"]] > 0 else 0.0
        tokens = share * ratios[r["mix_name"]] * corpus
        there = have.get(r["source"])
        cap, mean = float(r["cap"]), there["tokens"] / there["docs"] if there else 1.0
        exhausted = tokens > 0 and (there is None or tokens >= cap * there["tokens"])
        fixed = cap if exhausted else 0.0 if tokens <= 0 else None
        known = {"docs": float(there["docs"]), "square": there["squares"] / there["docs"]} if there else {"docs": 0.0, "square": 1.0}
        wanted.append({"mix_name": r["mix_name"], "source": r["source"], "share": share, "tokens": tokens, "cap": cap, "mean": float(mean), "fixed": fixed, "exhausted": exhausted, "tilt": 0.0, **known})
    plan = _Lines(spark, wanted)
    _solve(plan, histogram)
    _shifts(sizes, plan)
    one_more = F.coalesce((F.col("v") < F.col("shift")).cast("int"), F.lit(0))
    mix = (
        _draw(sizes, plan)
        .join(F.broadcast(plan.frame("shift")), ["mix_name", "source"])
        .withColumn("copies", (F.col("whole") + one_more).cast("int"))
        .where("copies > 0")
        .select("mix_name", "source", "doc_id", "n_tokens", F.round("rate", 12).alias("rate"), "copies")
    )
    reached = mix.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"))
    asked = spark.createDataFrame(
        [(t["mix_name"], t["source"], t["share"], t["tokens"], int(t["cap"]), t["exhausted"]) for t in wanted],
        "mix_name string, source string, target_share double, target_tokens double, max_repeats int, exhausted boolean",
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    shares = asked.join(F.broadcast(reached), ["mix_name", "source"], "left").select(
        "mix_name",
        "source",
        "target_share",
        F.coalesce(zero(F.col("actual_tokens")) / F.nullif(F.sum("actual_tokens").over(Window.partitionBy("mix_name")), F.lit(0)), F.lit(0.0)).alias("actual_share"),
        F.round("target_tokens", 3).alias("target_tokens"),
        *[zero(F.col(c)).cast("long").alias(c) for c in ("actual_tokens", "n_documents", "n_copies")],
        "max_repeats",
        "exhausted",
    )
    return mix, shares
