"""Time columns: tolerant parsing, buckets that restart at local midnight, choice of interval and axis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Interval steps in minutes for series, and tick steps for axes.
SERIES_STEPS = [1, 5, 10, 15, 30, 60, 120, 240, 480, 720, 1440]
TICK_STEPS = [15, 30, 60, 120, 180, 240, 360, 480, 720, 1440]


def parse_timestamp(text: Column) -> Column:
    """An ISO-8601 string as a timestamp, in extended or basic form; null if it is neither."""
    extended = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}")), text.try_cast("timestamp"))
    zone = F.when(F.rlike(text, F.lit(r"^\d{8}T\d{6}(Z|[+-]\d{4})$")), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmssXX")))
    return F.coalesce(extended, zone)


def wall_clock(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def bucket_start(ts: Column, minutes: int) -> Column:
    """Start of the bucket of ``minutes`` that holds the wall-clock time; buckets count from midnight of each day."""
    wall = wall_clock(ts)
    whole = F.floor((F.hour(wall) * 60 + F.minute(wall)) / minutes).cast("int") * minutes
    return F.date_trunc("DAY", wall).cast("timestamp_ntz") + F.make_dt_interval(mins=whole)


def step(minutes: int) -> Column:
    return F.make_dt_interval(mins=F.lit(minutes))


def minutes_between(earlier: Column, later: Column) -> Column:
    """Whole minutes between two wall-clock times."""
    return F.timestamp_diff("MINUTE", earlier, later)


def before(ts: Column, days: float) -> Column:
    """Exactly ``days`` times 24 hours earlier, as an instant."""
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) - int(days * 86_400_000_000))


def auto_interval(days: float, max_points: int = 100) -> int:
    """The finest step, in minutes, that is at least 1 % of the range and keeps to ``max_points``."""
    least = max(days * 1440 / 100, days * 1440 / max(max_points, 1))
    return next((s for s in SERIES_STEPS if s >= least), SERIES_STEPS[-1])


def tick_step(span_minutes: float) -> int:
    """The tick step nearest to 5 % of the span; the smaller of two equally near."""
    return min(TICK_STEPS, key=lambda s: abs(s - span_minutes * 0.05))


def axis_limit(value: Column, upward: bool = True) -> Column:
    """Rounded up (or down) to a multiple of 5, 5e3, 5e6 or 5e9, by its size."""
    unit = F.when(value >= 5_000_000_000, 5_000_000_000).when(value >= 5_000_000, 5_000_000).when(value >= 5_000, 5_000).otherwise(5).cast("long")
    whole = value.cast("long")
    return F.floor((whole + (unit - 1 if upward else 0)) / unit).cast("long") * unit


def level(value: Column, low: Column, high: Column, levels: int) -> Column:
    """The chart row, from 0, of a value between two limits."""
    return F.when(high == low, 0).otherwise(((value - low) / (high - low) * (levels - 1)).cast("int"))
