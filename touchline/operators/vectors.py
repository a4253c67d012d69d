"""Arrays of numbers: scaling, cropping, and the choice of a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minmax(v: Column) -> Column:
    """Scaled to [0, 1]; null where all elements are equal."""
    low, high = F.array_min(v), F.array_max(v)
    return F.transform(v, lambda x: F.try_divide(x - low, high - low))


def standardize(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """Each component less its mean over all rows, divided by its population deviation (1 if that is 0): <row_id>, pos, z.

    Means and deviations are one aggregation by component, whose result has as many rows as a vector has components.
    """
    flat = df.select(row_id, F.posexplode(vector).alias("pos", "x"))
    stats = flat.groupBy("pos").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return flat.join(F.broadcast(stats), "pos").select(row_id, "pos", ((F.col("x") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).alias("z"))


def crop(v: Column, width: int, x1: int, y1: int, x2: int, y2: int) -> Column:
    """Rows y1..y2-1 and columns x1..x2-1 of a row-major image."""
    return F.flatten(F.transform(F.sequence(F.lit(y1), F.lit(y2 - 1)), lambda y: F.slice(v, y * width + (x1 + 1), x2 - x1)))


def sample(v: Column, width: int, height: int, x: Column, y: Column) -> Column:
    """The value of a row-major image at a grid point, points outside moved to the border.

    A spline through the samples returns the sample at a grid point, so it isn't formed.
    """
    at = F.least(F.greatest(y, F.lit(0)), F.lit(height - 1)) * width + F.least(F.greatest(x, F.lit(0)), F.lit(width - 1))
    return F.get(v, at.cast("int"))


def torso(box: tuple[float, float, float, float], height: int, width: int) -> tuple[int, int, int, int]:
    """Bounds of the torso: from 15 to 50 % of the frame's height below the box's top, a quarter of its width in from either side.

    The shares are of the frame, not of the box, as the crop is defined.
    """
    x1, y1, x2, _ = box
    return int(x1 + width * 0.25), int(y1 + height * 0.15), int(x2 - width * 0.25), int(y1 + height * 0.50)


def pick_cluster(points: DataFrame, group: str, width: float) -> DataFrame:
    """The cluster nearest the top centre of each image, with the median of its colour.

    `points` has group, cluster, x, y, colour; the score of a cluster is its mean y plus half its mean x's distance from
    the middle; of equal scores, the first cluster wins.
    """
    clusters = points.groupBy(group, "cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.median("colour").alias("colour"))
    scored = clusters.withColumn("score", F.col("my") + 0.5 * F.abs(F.col("mx") - width / 2))
    best = scored.groupBy(group).agg(F.min(F.struct("score", "cluster", "colour")).alias("b"))
    return best.select(group, F.col("b.cluster").alias("cluster"), F.col("b.score").alias("score"), F.col("b.colour").alias("colour"))
