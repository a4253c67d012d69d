"""Order-dependent work over entities of any size.

A window over an entity puts all its rows into one task, which fails when one entity holds a third of the table. Here
rows are cut into shards by ranges of the order column; windows run within (entity, shard), and only one summary row
of each shard takes part in a window over the entity. With an integer order column of 32 bits, an entity has at most
2^32 / width summary rows, whatever the number of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = "_shard"


def shard_of(order: Column, width: int) -> Column:
    """Number of the range of `width` order values that holds the value; floors below zero too."""
    return F.floor(order.cast("double") / F.lit(float(width))).cast("long")


def with_neighbours(
    df: DataFrame, keys: Sequence[str], order: str, carried: Sequence[str], summary: Sequence[Column] = (), finish: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Add `_prev` and `_next`: the (order, *carried) struct of the neighbouring row of the same keys, or null.

    `df` has the column `_shard` and unique (keys, order). `summary` may hold aggregates of a shard; their sums over
    the entity come along under the aggregates' names, or what `finish` makes of them on the rows of shards.
    """
    keys = list(keys)
    record = F.struct(order, *carried)
    within = Window.partitionBy(*keys, SHARD).orderBy(order)
    edges = df.groupBy(*keys, SHARD).agg(
        F.min_by(record, order).alias("_first"), F.max_by(record, order).alias("_last"), *summary
    )
    names = [c for c in edges.columns if c not in {*keys, SHARD, "_first", "_last"}]
    across, whole = Window.partitionBy(*keys).orderBy(SHARD), Window.partitionBy(*keys)
    edges = edges.select(
        *keys,
        SHARD,
        F.lag("_last").over(across).alias("_before"),
        F.lead("_first").over(across).alias("_after"),
        *[F.sum(c).over(whole).alias(c) for c in names],
    )
    if finish is not None:
        edges = finish(edges)
    return (
        df.withColumn("_prev_in", F.lag(record).over(within))
        .withColumn("_next_in", F.lead(record).over(within))
        .join(edges, [*keys, SHARD])
        .withColumn("_prev", F.coalesce("_prev_in", "_before"))
        .withColumn("_next", F.coalesce("_next_in", "_after"))
        .drop("_prev_in", "_next_in", "_before", "_after")
    )


def pieces(df: DataFrame, keys: Sequence[str], order: str, carried: Sequence[str], gap: int) -> DataFrame:
    """keys, order, carried and `_piece`: the order value at which the row's piece begins, after a gap of at least `gap`.

    `df` has the column `_shard` and unique (keys, order). Only the last beginning of each shard takes part in a window
    over the keys.
    """
    keys = list(keys)
    columns = [*keys, SHARD, order, *carried]
    begins = F.when(F.col("_prev").isNull() | (F.col(order) - F.col(f"_prev.{order}") >= gap), F.col(order))
    cut = with_neighbours(df.select(*columns), keys, order, carried).select(*columns, begins.alias("_begins"))
    within = Window.partitionBy(*keys, SHARD).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    passed = cut.groupBy(*keys, SHARD).agg(F.max("_begins").alias("_b")).select(*keys, SHARD, F.max("_b").over(before).alias("_carried"))
    return cut.withColumn("_last", F.max("_begins").over(within)).join(passed, [*keys, SHARD]).select(*keys, order, *carried, F.coalesce("_last", "_carried").alias("_piece"))
