"""Wall-clock time parts.

All timestamps are TIMESTAMP_NTZ (local labels, no zone).  Truncation goes
through `window().start` or `trunc(date)`, both of which stay zone-free;
`date_trunc` on an NTZ column would return a zoned timestamp.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, functions as F

SLOT_MINUTES = 15
SLOTS_PER_DAY = 96

# fixed values: English day names, Monday first
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def slot_start(ts: Column | str, minutes: int = SLOT_MINUTES) -> Column:
    """Start of the tumbling bucket; one call per projection (a Spark limit)."""
    return F.window(_c(ts), f"{minutes} minutes")["start"]


def week_start(ts: Column | str) -> Column:
    """Monday of the ISO week, as a timestamp at midnight."""
    return F.trunc(F.to_date(_c(ts)), "week").cast("timestamp_ntz")


def month_start(ts: Column | str) -> Column:
    return F.trunc(F.to_date(_c(ts)), "month").cast("timestamp_ntz")


def quarter_of_hour(ts: Column | str) -> Column:
    return F.floor(F.minute(_c(ts)) / F.lit(SLOT_MINUTES)).cast("int")


def interval_idx(ts: Column | str) -> Column:
    """Slot of the day, 0..95."""
    return (F.hour(_c(ts)) * 4 + F.floor(F.minute(_c(ts)) / F.lit(SLOT_MINUTES))).cast("int")


def hour_fraction(ts: Column | str) -> Column:
    return F.hour(_c(ts)) + F.minute(_c(ts)) / F.lit(60.0)


def day_name(day: Column | str) -> Column:
    return F.date_format(_c(day), "EEEE")


def dow_mon0(day: Column | str) -> Column:
    """Monday = 0 .. Sunday = 6."""
    return F.weekday(_c(day))


def dow_sun1(day: Column | str) -> Column:
    """Sunday = 1 .. Saturday = 7."""
    return F.dayofweek(_c(day))


def mon0_to_sun1(dow: Column) -> Column:
    return (dow + F.lit(1)) % F.lit(7) + F.lit(1)


def is_weekend(day: Column | str) -> Column:
    return (F.weekday(_c(day)) >= 5).cast("int")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of a periodic value."""
    angle = F.lit(2.0 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def shift_days(ts: Column | str, days: int) -> Column:
    return _c(ts) + F.expr(f"interval '{days}' day")


def parse_day(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to date; malformed text becomes null."""
    return F.try_to_date(F.trim(text), fmt)


def parse_stamp(text: Column) -> Column:
    """ISO text to timestamp_ntz; malformed text becomes null."""
    return F.trim(text).try_cast("timestamp_ntz")


def stamp_text(value: str | datetime) -> str:
    """A stamp in one spelling, `YYYY-MM-DD HH:MM:SS`, whichever way it was given."""
    return (datetime.fromisoformat(value) if isinstance(value, str) else value).isoformat(sep=" ")


def ntz(value: str) -> Column:
    """A timestamp_ntz literal, folded at planning so that it reaches the scan."""
    return F.lit(value).cast("timestamp_ntz")


def in_period(ts: Column | str, start: str, end: str) -> Column:
    """Half-open [start, end) test on the raw column, so that the scan can skip on it."""
    return (_c(ts) >= ntz(start)) & (_c(ts) < ntz(end))
