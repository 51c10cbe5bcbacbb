"""Dates in text, periods and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from descry.functions.strings import strip

#: Tried in this order; where day and month could be swapped, the day comes first.
FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "M/d/yyyy H:mm",
    "MMMM d, yyyy", "d-MMM-yy", "yyyy/MM/dd",
]
UNITS = ["year", "quarter", "month", "week", "day", "hour", "minute", "second"]


def parse(text: Column, first: str | None = None) -> Column:
    """The instant that a text stands for in the first format that fits, or null. `first` is tried before the others: a column's dominant format."""
    return F.coalesce(*[F.try_to_timestamp(strip(text), F.lit(f)) for f in ([first] if first else []) + FORMATS]).cast("timestamp_ntz")


def parsed_format(text: Column) -> Column:
    """The first format that fits, or null."""
    return F.coalesce(*[F.when(F.try_to_timestamp(strip(text), F.lit(f)).isNotNull(), f) for f in FORMATS])


def formats(text: Column) -> list[Column]:
    """For each format, how many texts fit it; a text can fit several."""
    return [F.count(F.try_to_timestamp(strip(text), F.lit(f))).alias(f) for f in FORMATS]


def period(instant: Column, unit: str) -> Column:
    return F.date_trunc(unit, instant).cast("timestamp_ntz")


def cycle(instant: Column, part: str) -> Column:
    """month 1-12, quarter 1-4, weekday 1 (Monday) - 7, hour 0-23."""
    return {"month": F.month(instant), "quarter": F.quarter(instant), "weekday": F.weekday(instant) + 1, "hour": F.hour(instant)}[part]


def between(start: Column, end: Column) -> Column:
    """Seconds from start to end."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def smart_unit(seconds: float) -> tuple[float, str]:
    """A duration in the largest of s, min, h, d that it fills once."""
    for unit, size in (("d", 86400.0), ("h", 3600.0), ("min", 60.0)):
        if abs(seconds) >= size:
            return seconds / size, unit
    return seconds, "s"
