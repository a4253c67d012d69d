"""Streams over the tables: insertion of absent states, moving averages, gates and windows over late data.

A stream is run to the end of the files there are, over any number of micro-batches. Each micro-batch is written to a folder of its own number, so a
batch that is run again replaces its former output.
"""

from __future__ import annotations

import base64
import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.session import shared_dir, ship


def drain(stream: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream until its files are read; the written rows, or with `keys` each key's row of the last batch."""
    spark: SparkSession = stream.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, batch long").option("basePath", f"{path}/out").parquet(f"{path}/out")
    if not keys:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest]).select(*stream.columns)


def first_states(states: DataFrame, time: str = "created_at", late: str = "30 days") -> DataFrame:
    """One state per player and frame with all its columns, whichever comes first.

    The stream's state keeps the keys seen until the watermark of `time` passes them by `late`, so it is bounded by the
    keys of that span. A state that comes later than that behind the newest is left out, as are states without time.
    """
    return states.withWatermark(time, late).dropDuplicatesWithinWatermark(["player_id", "frame_number"])


def _folded(rows: DataFrame, key: str, order: str, value: str, tie: str, result: str, start: tuple, fold: Callable, horizon: int) -> DataFrame:
    """A fold over the rows of a key in order, however they are spread over micro-batches.

    The state holds the fold's value before the horizon and the rows within it: those at most `horizon` behind the
    furthest one. Rows that arrive out of order, and copies of rows in other batches, take their place among them, and
    the rows from there on come out again with their new results: the last result of a row is the right one. Of rows at
    one place the one with the smallest tie value counts, as in the batch operators; one without a value holds the place.
    A row that comes later than the horizon is left out.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, passed, held = pickle.loads(base64.b64decode(state.get[0])) if state.exists else (start, None, {})
        known = dict(held)
        for df in parts:
            for at, t, v in zip(df[order].tolist(), df[tie].tolist(), df[value].tolist(), strict=True):
                if (passed is None or at > passed) and (at not in held or t < held[at][0]):
                    held[at] = (t, v)
        places = sorted(held)
        changed = next((i for i, at in enumerate(places) if known.get(at) != held[at]), len(places))
        out_at, out, value_now = [], [], base
        keep_from = places[-1] - horizon if places else None
        new_base = base
        for i, at in enumerate(places):
            v = held[at][1]
            if v is not None and v == v:
                value_now, r = fold(value_now, at, v)
                if i >= changed:
                    out_at.append(at)
                    out.append(r)
            if at < keep_from:
                new_base, passed = value_now, at
        held = {at: x for at, x in held.items() if at >= keep_from} if places else held
        state.update((base64.b64encode(pickle.dumps((new_base, passed, held))).decode(),))
        yield pd.DataFrame({key: [k[0]] * len(out), order: out_at, result.split()[0]: out})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} int, {order} int, {result}", "held string", "update", GroupStateTimeout.NoTimeout)


def moving_average(rows: DataFrame, key: str, order: str, value: str, tie: str, alpha: float = 0.2, horizon: int = 20_000) -> DataFrame:
    """Moving average of the batch operator: key, order, ema; a row may come out again with a better value."""

    def fold(s: float, at: int, x: float) -> tuple[float, float]:
        s = alpha * x + (1 - alpha) * s
        return s, s

    return _folded(rows, key, order, value, tie, "ema double", 0.0, fold, horizon)


def gate(rows: DataFrame, key: str, order: str, scale: str, tie: str, frames: int = 250, change: float = 0.05, horizon: int = 20_000) -> DataFrame:
    """Which rows fire, see the batch operator; a row may come out again with another answer."""

    def fold(last: tuple | None, at: int, s: float) -> tuple[tuple, bool]:
        fire = last is None or (abs(s - last[1]) / last[1] if last[1] else 0.0) > change or at - last[0] >= frames
        return ((at, s) if fire else last), bool(fire)

    return _folded(rows, key, order, scale, tie, "fired boolean", None, fold, horizon)


def windowed_counts(rows: DataFrame, time: str, keys: list[str], late: str = "1 hour", length: str = "10 minutes") -> DataFrame:
    """Rows per event-time window; rows later than `late` behind the newest are left out."""
    return rows.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("n"))
