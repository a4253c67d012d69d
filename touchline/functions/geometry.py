"""Box, distance and movement arithmetic. Null operands give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of colour, position and time in the score of joining two track pieces, and the factor for short-lived pieces.
COLOUR_WEIGHT, POSITION_WEIGHT, TIME_WEIGHT = 0.5, 0.3, 0.2
GHOST_FACTOR = 0.9


def centre(low: Column, high: Column) -> Column:
    return (low + high) / 2


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two inclusive ranges share a unit."""
    return F.greatest(a_start, b_start) <= F.least(a_end, b_end)


def join_score(colour: Column, position: Column, gap: Column, ghost: Column) -> Column:
    score = COLOUR_WEIGHT * colour + POSITION_WEIGHT * (position / 10) + TIME_WEIGHT * (gap / 100)
    return F.when(ghost, score * GHOST_FACTOR).otherwise(score)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def point_in_box(share: Column, low: Column, high: Column) -> Column:
    """The place at a share of the box, or its centre where the share is unknown."""
    return F.coalesce(low + share * (high - low), centre(low, high))


def whole_seconds(seconds: Column) -> Column:
    return seconds.cast("int")


def kinematics(dx: Column, dy: Column, dt: Column) -> dict[str, Column]:
    """Speed and acceleration of a uniform movement over dt; null where dt is 0.

    The acceleration left over by the mean velocity is zero up to rounding; it is kept as it is defined.
    """
    vx, vy = F.try_divide(dx, dt), F.try_divide(dy, dt)
    ax, ay = F.try_divide(2 * (dx - vx * dt), dt * dt), F.try_divide(2 * (dy - vy * dt), dt * dt)
    fx, fy = vx + ax * dt, vy + ay * dt
    return {"vx": fx, "vy": fy, "acceleration": F.sqrt(ax * ax + ay * ay), "speed_kmh": F.sqrt(fx * fx + fy * fy) * 3.6}


def inverse_depth(depth: Column, scale: Column) -> Column:
    return F.abs(F.try_divide(F.lit(1.0), depth * scale))


def relative_change(now: Column, before: Column) -> Column:
    """Relative change, 0 where the former value is 0."""
    return F.when(before != 0, F.abs(now - before) / before).otherwise(F.lit(0.0))
