"""Sizes, rectangles and the tone of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the look: exposure gain, and how much of the contrast curve is blended in.
GAIN, BLEND = 1.3, 0.35


def fit_dimensions(width: Column, height: Column, longest: Column) -> Column:
    """STRUCT(width, height) with the long edge at most ``longest``; null if it is already."""
    scale = longest / F.greatest(width, height)
    edge = lambda x: F.greatest(F.round(x * scale), F.lit(1)).cast("int")
    return F.when(F.greatest(width, height) > longest, F.struct(edge(width).alias("width"), edge(height).alias("height")))


def oriented_rect(orientation: Column, x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A rectangle of a width x height image as it lies after the rotation."""
    rect = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("w"), d.alias("h"))
    return (
        F.when(orientation == "R90", rect(height - y - h, x, h, w))
        .when(orientation == "R180", rect(width - x - w, height - y - h, w, h))
        .when(orientation == "R270", rect(y, width - x - w, h, w))
        .otherwise(rect(x, y, w, h))
    )


def tone_curve(v: Column) -> Column:
    """Linear 0..1 to an 8-bit display value: gain with roll-off, sRGB gamma, contrast."""
    v = F.least(F.greatest(v.cast("double"), F.lit(0.0)), F.lit(1.0))
    lifted = GAIN * v / (1 + (GAIN - 1) * v)
    gamma = F.when(lifted <= 0.0031308, 12.92 * lifted).otherwise(1.055 * F.pow(lifted, F.lit(1 / 2.4)) - 0.055)
    smooth = gamma * gamma * (3 - 2 * gamma)
    return F.round(255 * ((1 - BLEND) * gamma + BLEND * smooth)).cast("int")
