"""Number and vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Rounded half to even."""
    return F.bround(value, digits)


def clamp01(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


def parse_fraction(text: Column) -> Column:
    """``a/b`` as a number with three decimals; 0 for anything else and for a zero denominator."""
    parts = F.split(text, "/")
    value = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    return F.coalesce(F.when(F.size(parts) == 2, F.bround(value, 3)), F.lit(0.0))


def frame_time(number: Column, fps: float) -> Column:
    """Seconds of a frame from its 1-based number."""
    return (number - 1) / F.lit(float(fps))


def dedup_ratio(states: Column, segments: Column) -> Column:
    return F.when(segments > 0, F.bround(1 - states / segments, 3)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b of unit vectors, which aren't normalised again."""
    return F.lit(1.0) - dot(a, b)


def l2_normalized(v: Column) -> Column:
    """v / |v|, or v where |v| is 1e-8 or less."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 1e-8, F.transform(v, lambda x: x / norm)).otherwise(v)
