"""Overlapping and gapped intervals: run-compressed bitmaps per entity and time shard, united and read out again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordered import SHARD, shard_of

#: Time units of one shard.
WIDTH = 32768


def _united(pieces: DataFrame, width: int) -> DataFrame:
    """Bitmaps from (key, _shard, lo, hi) pieces with offsets inside the shard.

    Of pieces with the same first bit only the longest matters, so at most `width` pieces of an entity and shard
    survive the partial aggregation before the shuffle, however many rows overlap there.
    """
    longest = pieces.groupBy("key", SHARD, "lo").agg(F.max("hi").alias("hi"))
    w = Window.partitionBy("key", SHARD).orderBy("lo")
    opens = F.col("lo") > F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    runs = (
        longest.repartition("key", SHARD)
        .withColumn("_opens", opens.cast("int"))
        .withColumn("_run", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", SHARD, "_run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    return runs.groupBy("key", SHARD).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def run_bitmaps(df: DataFrame, key: str, start: str, end: str, width: int = WIDTH) -> DataFrame:
    """The bitmap of covered time units of each entity, one row per time shard: key, _shard, runs of (lo, hi) offsets.

    A bitmap is held as its runs of set bits, so a long interval costs one run per shard. Rows with a null key or
    bound, or with start > end, don't count.
    """
    rows = df.select(F.col(key).alias("key"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).dropna().where("s <= e")
    pieces = rows.withColumn(SHARD, F.explode(F.sequence(shard_of(F.col("s"), width), shard_of(F.col("e"), width)))).select(
        "key",
        SHARD,
        F.greatest(F.col("s") - F.col(SHARD) * width, F.lit(0)).cast("int").alias("lo"),
        F.least(F.col("e") - F.col(SHARD) * width, F.lit(width - 1)).cast("int").alias("hi"),
    )
    return _united(pieces, width)


def union_bitmaps(*bitmaps: DataFrame, width: int = WIDTH) -> DataFrame:
    """Union of bitmaps of the same width, as of separate days."""
    both = reduce(DataFrame.unionByName, bitmaps)
    return _united(both.select("key", SHARD, F.inline("runs")), width)


def set_and_clear_runs(bitmaps: DataFrame, key: str, start: str, end: str, width: int = WIDTH) -> DataFrame:
    """Read out the bitmaps: key, kind ("period" or "gap"), first and last time unit (int) of each run.

    Runs that touch across a shard's border are one period. Only one summary row per shard takes part in the window
    over an entity.
    """
    at = F.col(SHARD) * width
    first, last = F.element_at("runs", 1), F.element_at("runs", -1)
    summary = bitmaps.select(
        "key",
        SHARD,
        F.size("runs").alias("_size"),
        (first["lo"] + at).alias("_first_lo"),
        (last["lo"] + at).alias("_last_lo"),
        (last["hi"] + at).alias("_last_hi"),
    )
    w = Window.partitionBy("key").orderBy(SHARD)
    summary = summary.withColumn("_before", F.lag("_last_hi").over(w)).withColumn(
        "_joined", F.coalesce(F.col("_before") + 1 == F.col("_first_lo"), F.lit(False))
    )
    summary = summary.withColumn("_open", F.when((F.col("_size") > 1) | ~F.col("_joined"), F.col("_last_lo")))
    summary = summary.withColumn("_chain", F.last("_open", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    summary = summary.select(
        "key",
        SHARD,
        "_before",
        "_joined",
        F.lag("_chain").over(w).alias("_chain"),
        F.coalesce(F.lead("_joined").over(w), F.lit(False)).alias("_goes_on"),
    )
    rows = bitmaps.join(summary, ["key", SHARD])

    def period(r, i):
        head, tail = (i == 0) & F.col("_joined"), (i == F.size("runs") - 1) & F.col("_goes_on")
        return F.struct(
            F.lit("period").alias("kind"),
            F.when(head, F.col("_chain")).otherwise(r["lo"] + at).alias("s"),
            F.when(~tail, r["hi"] + at).alias("e"),
        )

    def gap(r, i):
        before = F.when(i == 0, F.col("_before")).otherwise(F.get("runs", i - 1)["hi"] + at)
        return F.struct(F.lit("gap").alias("kind"), (before + 1).alias("s"), (r["lo"] + at - 1).alias("e"))

    return (
        rows.select("key", F.inline(F.concat(F.transform("runs", period), F.transform("runs", gap))))
        .where("s <= e")
        .select(F.col("key").alias(key), "kind", F.col("s").cast("int").alias(start), F.col("e").cast("int").alias(end))
    )


def merge_intervals(df: DataFrame, key: str = "player_id", start: str = "frame_start", end: str = "frame_end", width: int = WIDTH) -> DataFrame:
    """Continuous periods of each entity and the gaps between them; bounds are inclusive integers.

    Intervals that overlap, nest or follow each other without a unit between belong to one period. Rows with a null key
    or bound or with start > end don't count; copies change nothing; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    return set_and_clear_runs(run_bitmaps(df, key, start, end, width), key, start, end, width)
