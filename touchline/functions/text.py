"""Labels, storage keys and other strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders of the purposes a stored file can have; other purposes have none.
PURPOSE_FOLDERS = {"player_image": "players", "heatmap": "heatmaps", "reports": "reports"}


def storage_key(match: Column, name: Column, purpose: Column, extension: str, unique: Column | None = None) -> Column:
    """<match>/[<folder>/]<name>_<unique>.<extension>; `unique` is a random UUID unless given."""
    folder = F.lit("")
    for k, v in PURPOSE_FOLDERS.items():
        folder = F.when(purpose == k, F.lit(f"{v}/")).otherwise(folder)
    unique = F.expr("uuid()") if unique is None else unique
    return F.concat(match.cast("string"), F.lit("/"), folder, name, F.lit("_"), unique.cast("string"), F.lit(f".{extension}"))


def public_url(base: str, key: Column) -> Column:
    return F.concat(F.lit(f"{base}/"), key)


def image_name(match: Column, frame: Column, track: Column) -> Column:
    return F.concat_ws("_", *[c.cast("string") for c in (match, frame, track)])


def two_decimals(x: Column) -> Column:
    """Text with two decimals, rounded by the number's exact binary value, as C and Python do.

    100 x is taken as a sum of two doubles, so that a value beside a tie isn't mistaken for one.
    """
    split = x * F.lit(134217729.0)
    high = split - (split - x)
    product = x * 100
    error = (high * 100 - product) + (x - high) * 100
    low = F.floor(product)
    rest = product - low
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (low % 2 != 0))))
    return F.format_string("%.2f", (low + up.cast("int")) / 100)


def label(track: Column, hex_text: Column, confidence: Column) -> Column:
    """ID, colour and confidence with two decimals, as drawn beside a box."""
    return F.concat(F.lit("ID: "), track.cast("string"), F.lit(" |"), hex_text, F.lit("| Conf: "), two_decimals(confidence))


def box_text(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.concat_ws(", ", *[F.coalesce(c.cast("double").cast("string"), F.lit("None")) for c in (x1, y1, x2, y2)])


def text_or_none(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))
