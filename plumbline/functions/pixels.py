"""Pixel rules on red, green, blue and alpha columns from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col


def luma(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """ITU-R 601 luma in 16-bit fixed point."""
    return F.shiftright(col(r).cast("int") * 19595 + col(g).cast("int") * 38470 + col(b).cast("int") * 7471 + 32768, 16)


def rgba_hex(*channels: Column | str) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(col(c).cast("long")), 2, "0") for c in channels])


def near_white(r: Column | str, g: Column | str, b: Column | str, low: int = 208, spread: int = 48) -> Column:
    least, most = F.least(col(r), col(g), col(b)), F.greatest(col(r), col(g), col(b))
    return (least >= low) & (most - least <= spread)


def near_palette(r: Column | str, g: Column | str, b: Column | str, palette: Column | str, tolerance: Column | str | int) -> Column:
    """Whether any colour of an array<struct<r, g, b>> lies within the tolerance."""
    t = F.lit(tolerance) if isinstance(tolerance, int) else col(tolerance)
    square = lambda v: v * v
    return F.exists(palette, lambda p: square(col(r) - p["r"]) + square(col(g) - p["g"]) + square(col(b) - p["b"]) <= t * t)
