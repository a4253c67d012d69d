"""Irregular readings onto a regular grid: harmonic regression with trend, bridged between observed endpoints."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordered import SHARD, shard_of, with_neighbours
from touchline.session import ship, written

#: Slots of one shard of an entity, and of one piece of a long gap.
SHARD_SLOTS = 64
PIECE_SLOTS = 4096


def _basis(u: Column, harmonics: int) -> list[Column]:
    turns = [F.lit(2 * math.pi * h) * u for h in range(1, harmonics + 1)]
    return [F.lit(1.0), u, *[f(x) for x in turns for f in (F.cos, F.sin)]]


def _solver(size: int, n_values: int, ridge: float):
    """Solve the normal equations of many entities at once; null, and entities without finite slots, get null."""
    rows, cols = np.triu_indices(size)
    n_upper = len(rows)

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        given = sums[sums.notna()]
        flat = np.array([np.asarray(x, dtype=float) for x in given]).reshape(len(given), n_upper + n_values * size)
        a = np.zeros((len(flat), size, size))
        a[:, rows, cols] = flat[:, :n_upper]
        a[:, cols, rows] = flat[:, :n_upper]
        b = flat[:, n_upper:].reshape(len(flat), n_values, size)
        n = np.maximum(a[:, 0, 0], 1e-9)
        # the trend is centred and scaled before solving, which keeps short series late in time well-conditioned
        centre = a[:, 0, 1] / n
        scale = np.sqrt(np.maximum(a[:, 1, 1] / n - centre**2, 1e-12))
        m = np.tile(np.eye(size), (len(flat), 1, 1))
        m[:, 1, 0], m[:, 1, 1] = -centre / scale, 1 / scale
        a, b = m @ a @ m.transpose(0, 2, 1), np.einsum("eij,evj->evi", m, b)
        penalty = np.full((len(flat), size), ridge) * (n[:, None] + 100.0)
        penalty[:, 0], penalty[:, 1] = 1e-9 * n + 1e-12, 1e-3 * n + ridge
        a[:, np.arange(size), np.arange(size)] += penalty
        beta = np.linalg.solve(a[:, None], b[..., None])[..., 0]
        beta = np.einsum("evi,eij->evj", beta, m).reshape(len(flat), n_values * size)  # a batch may hold no sums at all
        solved = pd.Series([None if k < 0.5 else x for k, x in zip(flat[:, 0], beta.tolist(), strict=True)], index=given.index, dtype=object)
        return solved.reindex(sums.index).where(lambda x: x.notna(), None)

    return solve


def regular_grid(
    readings: DataFrame,
    source: str = "player_id",
    time: str = "frame_number",
    values: Sequence[str] = ("dx_meters", "dy_meters"),
    step: int = 25,
    period: int = 1500,
    harmonics: int = 2,
    ridge: float = 0.02,
) -> DataFrame:
    """One row per source and slot of `step` time units, from the source's first to its last usable reading.

    Columns: source, grid_<time> (the slot's first time unit), n_readings (distinct usable readings in the slot),
    status, and each value. status is "observed" (the slot's mean), "filled" (predicted) or "marked" (no value can be
    predicted, as the source has no finite reading).

    The model of a source is a trend plus `harmonics` harmonics of `period` time units, fitted by least squares. Its
    normal equations are sums, taken per time shard and added up, so no source is gathered in one task. A missing slot
    gets the model's value plus the residual interpolated linearly between the nearest observed slots; the filled
    series meets its neighbours exactly.

    Nulls: rows without source, time or any of the values aren't usable and are left out. A reading that isn't finite
    is usable (its slot isn't missing) but takes no part in means and model; a slot of only such readings gets the
    model's value and remains "observed". Copies and second readings with equal values of a time unit count once;
    differing readings of a time unit are averaged. An empty table gives an empty grid. Other columns are ignored.
    """
    ship(readings.sparkSession)
    values = list(values)
    v = [f"_v{i}" for i in range(len(values))]
    usable = readings.select(
        F.col(source).alias("_src"), F.col(time).cast("long").alias("_t"), *[F.col(c).cast("double").alias(n) for c, n in zip(values, v, strict=True)]
    )
    usable = usable.where(" and ".join(f"{c} is not null" for c in usable.columns))
    usable = usable.withColumn("_slot", shard_of(F.col("_t"), step)).withColumn(SHARD, shard_of(F.col("_slot"), SHARD_SLOTS))
    finite = F.lit(True)
    for n in v:
        finite = finite & ~F.isnan(n) & (F.abs(n) != F.lit(float("inf")))
    slots = (
        usable.distinct()  # copies go before the slots are formed
        .groupBy("_src", SHARD, "_slot")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.when(finite, F.col(n))).alias(n) for n in v])
    )
    slots = written(slots, "slots")  # both the sums and the rows below read them

    size = 2 + 2 * harmonics
    slot_period = F.lit(period / step)
    basis = _basis(F.col("_slot") / slot_period, harmonics)
    known = F.col(v[0]).isNotNull()
    sums = [basis[i] * basis[j] for i in range(size) for j in range(i, size)]
    sums += [F.col(n) * b for n in v for b in basis]
    names = [f"_s{i}" for i in range(len(sums))]

    def solved(edges: DataFrame) -> DataFrame:
        # the sums of a source are solved on the row of its first shard, and only the coefficients go to the others
        first = F.row_number().over(Window.partitionBy("_src").orderBy(SHARD)) == 1
        own = edges.withColumn("_sums", F.when(first, F.array(*names))).drop(*names).withColumn("_own", _solver(size, len(v), ridge)("_sums"))
        return own.withColumn("_beta", F.first("_own", True).over(Window.partitionBy("_src"))).drop("_sums", "_own")

    rows = with_neighbours(slots, ["_src"], "_slot", v, [F.sum(F.when(known, s).otherwise(0.0)).alias(n) for s, n in zip(sums, names, strict=True)], solved)

    def model(i: int, slot: Column) -> Column:
        terms = _basis(slot / slot_period, harmonics)
        total = F.lit(0.0)
        for k, term in enumerate(terms):
            total = total + F.col("_beta")[i * size + k] * term
        return total

    rest = []
    for i, n in enumerate(v):
        left = F.coalesce(F.col(n) - model(i, F.col("_slot")), F.lit(0.0))
        right = F.coalesce(F.col(f"_next.{n}") - model(i, F.col("_next._slot")), F.lit(0.0))
        rest += [left.alias(f"_l{i}"), right.alias(f"_r{i}")]
    last = F.coalesce(F.col("_next._slot") - 1, F.col("_slot"))
    piece = F.explode(F.sequence(shard_of(F.col("_slot"), PIECE_SLOTS), shard_of(F.col("_last"), PIECE_SLOTS)))
    out = (
        rows.select("_src", "_slot", "_n", "_beta", *v, *rest, F.col("_next._slot").alias("_right"), last.alias("_last"))
        .withColumn("_piece", piece)
        .withColumn(
            "_g",
            F.explode(
                F.sequence(
                    F.greatest(F.col("_slot"), F.col("_piece") * PIECE_SLOTS),
                    F.least(F.col("_last"), F.col("_piece") * PIECE_SLOTS + (PIECE_SLOTS - 1)),
                )
            ),
        )
    )
    observed = F.col("_g") == F.col("_slot")
    share = (F.col("_g") - F.col("_slot")) / (F.col("_right") - F.col("_slot"))
    filled = [model(i, F.col("_g")) + F.col(f"_l{i}") + F.coalesce(share, F.lit(0.0)) * (F.col(f"_r{i}") - F.col(f"_l{i}")) for i in range(len(v))]
    series = [F.when(observed & F.col(n).isNotNull(), F.col(n)).otherwise(x) for n, x in zip(v, filled, strict=True)]
    return out.select(
        F.col("_src").alias(source),
        (F.col("_g") * step).cast("int").alias(f"grid_{time.removesuffix('_number')}"),
        F.when(observed, F.col("_n")).otherwise(F.lit(0)).cast("int").alias("n_readings"),
        F.when(observed, F.lit("observed")).when(series[0].isNotNull(), F.lit("filled")).otherwise(F.lit("marked")).alias("status"),
        *[x.alias(c) for x, c in zip(series, values, strict=True)],
    )
