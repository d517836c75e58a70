"""Numeric rules: half-even rounding, fixed-point units, rotations, tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the document format: units in one whole for percentages and in one degree for angles.
PERCENT_UNITS, ANGLE_UNITS = 100_000, 60_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(value: Column | str, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(col(value), digits)


def percent_units(share: Column | str) -> Column:
    """A share as whole fixed-point percentage units; null for null and non-finite values."""
    return _whole(col(share).cast("double") * PERCENT_UNITS)


def angle_units(degrees: Column | str) -> Column:
    """Degrees as whole fixed-point angle units; null for null and non-finite values."""
    return _whole(col(degrees).cast("double") * ANGLE_UNITS)


def _whole(v: Column) -> Column:
    return F.when(is_finite(v), F.bround(v).cast("long"))


def is_finite(value: Column | str) -> Column:
    v = col(value).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def wrap_rotation(degrees: Column | str) -> Column:
    """The equal rotation in [0, 360): the floored remainder."""
    return F.pmod(col(degrees), F.lit(360))


def canonical_rotation(degrees: Column | str) -> Column:
    v = col(degrees)
    return is_finite(v) & (v >= 0) & (v < 360)


def storable_rotation(degrees: Column | str) -> Column:
    """Strictly between -360 and 360, and not lost in rounding to angle units unless it is zero."""
    v = col(degrees)
    return is_finite(v) & (v > -360) & (v < 360) & ((v == 0) | (angle_units(v) != 0))


def near(a: Column | str, b: Column | str, tolerance: float = 0.01) -> Column:
    """Equal, or numbers at most `tolerance` apart; nulls are equal to each other only."""
    a, b = col(a), col(b)
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def font_size_allowed(points: Column | str) -> Column:
    v = col(points)
    return F.coalesce(is_finite(v) & (v >= 1) & (v <= 4000), F.lit(False))


def round_rect_allowed(adjustment: Column | str) -> Column:
    """In (0, 0.5], and still so in fixed-point units."""
    units = percent_units(adjustment)
    return F.coalesce((col(adjustment) > 0) & (col(adjustment) <= 0.5) & units.between(1, PERCENT_UNITS // 2), F.lit(False))


def run_value(kind: str, value: Column | str) -> Column:
    """A text run's property in comparable form: sizes in hundredths, weights as bold or not, colours in upper case."""
    v = col(value)
    return {"size": F.bround(v.cast("double") * 100).cast("long"), "weight": v >= 600, "color": F.upper(v), "flag": F.coalesce(v, F.lit(False))}[kind]
