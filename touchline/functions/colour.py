"""Colours as "r,g,b" strings and their perceptual distance in CIE-Lab."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ for the D65 white point, and that white point.
XYZ_ROWS = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)


def parse_rgb(text: Column) -> Column:
    """[r, g, b] of "r,g,b", blanks allowed; null unless there are three whole numbers."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    return F.when((F.size(parts) == 3) & F.forall(parts, lambda x: x.isNotNull()), parts)


def lab(rgb: Column) -> list[Column]:
    """L, a and b of an array of 0..255 channels."""

    def linear(i: int) -> Column:
        c = F.get(rgb, F.lit(i)) / F.lit(255.0)
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)

    channels = [linear(i) for i in range(3)]

    def f(i: int) -> Column:
        t = sum((c * w for c, w in zip(channels[1:], XYZ_ROWS[i][1:], strict=True)), channels[0] * XYZ_ROWS[i][0]) / WHITE[i]
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)

    x, y, z = f(0), f(1), f(2)
    return [116 * y - 16, 500 * (x - y), 200 * (y - z)]


def lab_distance(a: list[Column], b: list[Column]) -> Column:
    squares = [(p - q) * (p - q) for p, q in zip(a, b, strict=True)]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def hex_colour(rgb: Column) -> Column:
    channels = [F.lpad(F.lower(F.hex(F.get(rgb, F.lit(i)))), 2, "0") for i in range(3)]
    return F.concat(F.lit("#"), *channels)


def rgb_text(rgb: Column) -> Column:
    return F.concat_ws(",", *[F.get(rgb, F.lit(i)).cast("string") for i in range(3)])


def check_annotator(hex_colour: str, thickness: float = 1, text_scale: float = 0.5) -> None:
    """Raise ValueError unless the colour is # and six signs, and both sizes lie in (0, 100]."""
    if not hex_colour.startswith("#") or len(hex_colour) != 7:
        raise ValueError(f"{hex_colour!r} isn't a colour of # and six signs")
    for name, size in (("thickness", thickness), ("text_scale", text_scale)):
        if not 0 < size <= 100:
            raise ValueError(f"{name} must be above 0 and at most 100")


def mean_rgb(text: Column) -> Column:
    """Aggregate: the mean of "r,g,b" colours by channel, cut to whole numbers, as "r,g,b"; null without a colour."""
    rgb = parse_rgb(text)
    channels = [F.avg(F.get(rgb, F.lit(i))).cast("int") for i in range(3)]
    return F.when(channels[0].isNotNull(), F.concat_ws(",", *[c.cast("string") for c in channels]))


def is_hex_colour(text: Column) -> Column:
    return text.rlike("^#.{6}$")
