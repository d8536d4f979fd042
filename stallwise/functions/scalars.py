"""Column expressions shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def elapsed(start: Column | str, end: Column | str, unit_seconds: float) -> Column:
    """Signed time from ``start`` to ``end`` in units of ``unit_seconds`` (DOUBLE)."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(unit_seconds * 1e6)


def days_between(start: Column | str, end: Column | str) -> Column:
    return elapsed(start, end, 86400.0)


def hours_between(start: Column | str, end: Column | str) -> Column:
    return elapsed(start, end, 3600.0)


def month_of(ts: Column | str) -> Column:
    return F.trunc(F.to_date(ts), "MM")


def month_number(date: Column | str) -> Column:
    return F.year(date) * 12 + F.month(date)


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ratio(top: Column, bottom: Column) -> Column:
    """DOUBLE division that gives NULL for a zero divisor."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def mean_of(col: str) -> Column:
    """Mean as exact SUM over COUNT, so that decimals do not depend on row order."""
    return ratio(F.sum(col), F.count(col))


def great_circle_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance; NULL unless all four coordinates are present."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (half_lng * half_lng)
    # rounding can push the chord of antipodal points past 1; least() must not hide a NULL input
    clamped = F.when(chord > 1.0, F.lit(1.0)).otherwise(chord)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamped))


def hash_unit(salt: str, *cols: str) -> Column:
    """Reproducible uniform number in [0, 1) per key: first 32 bits of a salted MD5."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in cols], F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
