"""Collapsing repeated consecutive events: adjacent agglomeration with a linked list and a priority queue."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordered import SHARD, pieces, shard_of
from touchline.session import ship, written

#: Time units of one shard of an entity. Must exceed the gap limit.
WIDTH = 4096
RUNS = f"key long, {SHARD} long, no int, size int, first long, last long, n long, mean double"


def agglomerate(times: Sequence[int], values: Sequence[float], max_gap: int, max_distance: float) -> list[tuple[int, int, int, float]]:
    """Runs (first, last, count, mean value) of one ordered sequence.

    Every event starts as a run in a doubly linked list. A priority queue holds the neighbouring pairs that may merge,
    most similar first (difference of mean values, then gap, then position); the best pair is merged, and the pairs of
    the new run with its neighbours are queued anew, until no pair is similar and near enough.
    """
    n = len(times)
    first, last, count, mean = list(times), list(times), [1] * n, list(values)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    version = [0] * n
    queue = []
    for i in range(n - 1):
        gap = times[i + 1] - times[i]
        if gap <= max_gap:
            d = abs(values[i + 1] - values[i])
            if d <= max_distance:
                queue.append((d, gap, i, 0, 0))
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    while queue:
        _, _, i, vi, vj = pop(queue)
        if version[i] != vi:
            continue
        j = after[i]
        if j >= n or version[j] != vj:
            continue
        total = count[i] + count[j]
        if mean[i] != mean[j]:
            mean[i] = (mean[i] * count[i] + mean[j] * count[j]) / total
        last[i], count[i] = last[j], total
        version[i] += 1
        version[j] = -1
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            gap = first[k] - last[i]
            d = abs(mean[k] - mean[i])
            if gap <= max_gap and d <= max_distance:
                push(queue, (d, gap, i, version[i], version[k]))
        p = before[i]
        if p >= 0:
            gap = first[i] - last[p]
            d = abs(mean[i] - mean[p])
            if gap <= max_gap and d <= max_distance:
                push(queue, (d, gap, p, version[p], version[i]))
    out, i = [], 0
    while i < n:
        out.append((first[i], last[i], count[i], mean[i]))
        i = after[i]
    return out


def _collapser(max_gap: int, max_distance: float):
    def emit(key, shard, times, values):
        runs = agglomerate(times, values, max_gap, max_distance)
        return key, shard, runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(groups):
            keys, shards, nos, sizes, cols = [], [], [], [], [[], [], [], []]
            for key, shard, runs in groups:
                m = len(runs)
                keys += [key] * m
                shards += [shard] * m
                nos += range(m)
                sizes += [m] * m
                for c, x in zip(cols, zip(*runs, strict=True), strict=True):
                    c += x
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(shards, pa.int64()), pa.array(nos, pa.int32()), pa.array(sizes, pa.int32())]
                + [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                names=["key", SHARD, "no", "size", "first", "last", "n", "mean"],
            )

        held, now, groups, rows = None, ([], []), [], 0
        for b in batches:
            key, shard, t = (b.column(c).to_numpy() for c in ("key", SHARD, "t"))
            v = b.column("v").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (shard[1:] != shard[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(key)]
            t, v = t.tolist(), v.tolist()
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                if a == z:
                    continue
                here = (int(key[a]), int(shard[a]))
                if here != held and held is not None:
                    groups.append(emit(*held, *now))
                    rows += len(groups[-1][2])
                    now = ([], [])
                held = here
                now[0].extend(t[a:z])
                now[1].extend(v[a:z])
            if rows > 50_000:
                yield flush(groups)
                groups, rows = [], 0
        if held is not None:
            groups.append(emit(*held, *now))
        if groups:
            yield flush(groups)

    return run


def smooth_flickers(events: DataFrame, max_span: int) -> DataFrame:
    """Give an event whose two neighbours both differ from it, and lie at most `max_span` apart, their value; all at once.

    Both neighbours lie within `max_span` of the event, so rows near a shard's border are shown to the next shard too
    and the window stays within (key, _shard). Columns: key, _shard, t, v.
    """
    own = F.col(SHARD)
    shown = events.withColumn("_own", own).withColumn(
        SHARD, F.explode(F.sequence(shard_of(F.col("t") - max_span, WIDTH), shard_of(F.col("t") + max_span, WIDTH)))
    )
    w = Window.partitionBy("key", SHARD).orderBy("t")
    tp, tn, vp, vn = F.lag("t").over(w), F.lead("t").over(w), F.lag("v").over(w), F.lead("v").over(w)
    flicker = (vp != F.col("v")) & (vn != F.col("v")) & (vp == vn) & (tn - tp <= max_span)
    # `flicker` is null beside a shown shard's edge, where a neighbour is farther than max_span
    return (
        shown.withColumn("_new", F.when(flicker, vp).otherwise(F.col("v")))
        .where(F.col("_own") == F.col(SHARD))
        .select("key", SHARD, "t", F.col("_new").alias("v"))
    )


def collapse_runs(
    df: DataFrame,
    key: str = "player_id",
    time: str = "frame_number",
    value: str = "has_ball",
    max_gap: int = 50,
    max_span: int = 15,
    max_distance: float = 0.0,
) -> DataFrame:
    """Runs of equal or similar consecutive events: key, <value> (mean), first and last time, number of events.

    One event per key and time counts (of differing copies, the largest value). First, single events that differ from
    both near neighbours take their value (`max_span`, 0 for none). Then neighbouring runs are merged by similarity
    within `max_gap` and `max_distance`, see `agglomerate`.

    An entity is cut where no merge can cross. With max_distance 0 runs only join equal ones, whatever the order, so
    shards of time are agglomerated on their own and the runs that meet at a border are joined if gap and value allow.
    With a larger distance the order of merges matters, and the cuts are the gaps above `max_gap`: pieces between them
    are agglomerated on their own, each in one task. Both equal agglomeration of the whole sequence. Runs of shards are
    written to the shared folder before they are joined.

    Rows with a null key, time or value are no events. An empty table gives no rows; other columns are ignored.
    """
    ship(df.sparkSession)
    if max_gap >= WIDTH or max_span >= WIDTH:
        raise ValueError(f"max_gap and max_span must be below {WIDTH}")
    events = (
        df.select(F.col(key).cast("long").alias("key"), F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("v"))
        .dropna()
        .withColumn(SHARD, shard_of(F.col("t"), WIDTH))
        .groupBy("key", SHARD, "t")
        .agg(F.max("v").alias("v"))
    )
    if max_span > 0:
        events = smooth_flickers(events, max_span)
    else:
        events = events.repartition("key", SHARD)  # the window of the smoothing has done so already
    if max_distance > 0:
        whole = pieces(events, ["key"], "t", ["v"], max_gap + 1).withColumnRenamed("_piece", SHARD).repartition("key", SHARD).sortWithinPartitions("key", SHARD, "t")
        return _named(whole.mapInArrow(_collapser(max_gap, max_distance), RUNS), key, value)
    runs = written(
        events.sortWithinPartitions("key", SHARD, "t").mapInArrow(
            _collapser(max_gap, max_distance), RUNS
        ),
        "runs",
    )
    inner = runs.where("no > 0 and no < size - 1").select("key", "first", "last", "n", "mean")
    # border runs: at most two per shard take part in the window over the entity
    edge = runs.where("no = 0 or no = size - 1")
    w = Window.partitionBy("key").orderBy("first")
    joined = (
        (F.col("no") == 0)
        & (F.col("first") - F.lag("last").over(w) <= max_gap)
        & (F.abs(F.col("mean") - F.lag("mean").over(w)) <= max_distance)
    )
    chains = (
        edge.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("long"))
        .withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "_chain")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
        .drop("_chain")
    )
    return _named(inner.unionByName(chains), key, value)


def _named(runs: DataFrame, key: str, value: str) -> DataFrame:
    return runs.select(
        F.col("key").alias(key),
        F.col("mean").alias(value),
        F.col("first").cast("int").alias("frame_start"),
        F.col("last").cast("int").alias("frame_end"),
        F.col("n").cast("int").alias("n_readings"),
    )
