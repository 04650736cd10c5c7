"""Date parsing and ages. All timestamps are UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(x: Column, formats: list[str]) -> Column:
    """The first format that reads x; fields need no leading zeros."""
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats])


def published(x: Column) -> Column:
    """`2025-02-03T04:05:06` with or without an offset, or a date; null otherwise."""
    return _first(x, ["y-M-d'T'H:m:sXXX", "y-M-d'T'H:m:sXX", "y-M-d'T'H:m:s", "y-M-d"])


def event_date(x: Column) -> Column:
    """`2025-02-03`, `3 February 2025`, `February 3, 2025` or a date with a time; null otherwise."""
    return _first(x, ["y-M-d", "d MMMM y", "MMMM d, y", "y-M-d'T'H:m:s"])


def pdf_date(x: Column) -> Column:
    return F.try_to_timestamp(F.substring(F.regexp_replace(x, "^D:", ""), 1, 8), F.lit("yyyyMMdd"))


def freshness(pub: Column, as_of: dt.datetime | Column) -> Column:
    """1 on the day, falling to 0 over 365 days; .5 if the date is unknown, 1 if it lies ahead."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    days = F.floor((F.unix_micros(now) - F.unix_micros(pub)) / 86_400_000_000)
    return F.when(pub.isNull(), 0.5).when(days < 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - days / 365.0)))


def window_bias(pub: Column, start, end, hard: bool = False) -> Column:
    """1 inside the window, ends included; .75 if the date is unknown; .5 (0 if hard) outside."""
    return F.when(pub.isNull(), 0.75).when(pub.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")), 1.0).otherwise(0.0 if hard else 0.5)
