"""Pixels as structs of r, g, b (0 to 255), and what share of them is tissue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def grey(p: Column) -> Column:
    """Luma with weights of 15 bits, rounded."""
    return F.shiftright(9798 * p["r"] + 19235 * p["g"] + 3735 * p["b"] + 16384, 15)


def mean(p: Column) -> Column:
    return (p["r"] + p["g"] + p["b"]) / 3


def brightness(p: Column) -> Column:
    """The largest channel."""
    return F.greatest(p["r"], p["g"], p["b"])


def spread(p: Column) -> Column:
    """The largest channel less the smallest."""
    return brightness(p) - F.least(p["r"], p["g"], p["b"])


def saturation(p: Column) -> Column:
    """The spread as a share of the brightness, in 255ths, by a table of reciprocals of 12 bits; 0 for black."""
    v = brightness(p)
    return F.when(v == 0, 0).otherwise(F.shiftright(spread(p) * F.rint(F.lit(255 << 12) / v).cast("int") + 2048, 12))


#: The three definitions of a tissue pixel.
FRACTIONS: dict[str, Callable[[Column], Column]] = {
    "mean_grey": lambda p: mean(p) < 220,
    "colour": lambda p: (grey(p) < 235) | ((saturation(p) > 20) & (brightness(p) < 250)),
    "spread": lambda p: (mean(p) < 235) | (spread(p) > 12),
}


def tissue_fraction(pixels: Column, how: str = "colour", white: int | None = None) -> Column:
    """The share of an array's pixels that are tissue by one definition; null for an empty array. ``white`` is the limit of mean_grey."""
    if how not in FRACTIONS:
        raise ValueError(f"unknown definition {how}")
    if white is not None and how != "mean_grey":
        raise ValueError("only mean_grey has a limit of its own")
    test = FRACTIONS[how] if white is None else lambda p: mean(p) < white
    return F.try_divide(F.size(F.filter(pixels, test)), F.size(pixels))
