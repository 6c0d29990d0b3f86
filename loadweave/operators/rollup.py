"""Tumbling totals at several grains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import timeparts as t
from ..functions.numeric import total

GRAIN_COLUMN = {
    "15min": "datetime_15min",
    "hour": "datetime_hour",
    "day": "date",
    "week": "week_start",
    "month": "month_start",
}


def with_grain(df: DataFrame, grain: str, ts: str, out: str | None = None) -> DataFrame:
    out = out or GRAIN_COLUMN[grain]
    expr = {
        "15min": lambda: t.slot_start(ts, 15),
        "hour": lambda: t.slot_start(ts, 60),
        "day": lambda: F.to_date(F.col(ts)),
        "week": lambda: t.week_start(ts),
        "month": lambda: t.month_start(ts),
    }[grain]()
    return df.withColumn(out, expr)


def rollup(
    df: DataFrame,
    grain: str = "15min",
    keys: Sequence[str] = (),
    ts: str = "datetime_local",
    value: str = "active_kw",
    out: str = "total_active_kw",
    decimals: int | None = None,
) -> DataFrame:
    """Sum per (keys, bucket): one scan of the needed columns, one shuffle of partial sums.

    Partial aggregation runs before the shuffle, so a key that holds a third of
    the readings still sends one row per task and bucket.  Readings without a
    time belong to no bucket.
    """
    col = GRAIN_COLUMN[grain]
    src = with_grain(df.select(*keys, ts, value), grain, ts, col).where(F.col(col).isNotNull())
    return src.groupBy(*keys, col).agg(total(value, decimals).alias(out))


def coarsen(
    df15: DataFrame, grain: str, keys: Sequence[str] = (), value: str = "total_active_kw", decimals: int | None = None
) -> DataFrame:
    """A coarser grain from the 15-minute totals (sums add up, so no second raw scan)."""
    return rollup(df15, grain, keys, ts="datetime_15min", value=value, out=value, decimals=decimals)


def all_grains(df15: DataFrame, keys: Sequence[str], decimals: int | None = None) -> dict[str, DataFrame]:
    """The five per-key rollups; the caller should pass a materialised 15-minute frame."""
    frames = {"15min": df15}
    for grain in ("hour", "day", "week", "month"):
        frames[grain] = coarsen(df15, grain, keys, decimals=decimals)
    return frames


def daily_with_name(df: DataFrame, keys: Sequence[str] = ("community_code",), decimals: int | None = None) -> DataFrame:
    return rollup(df, "day", keys, decimals=decimals).withColumn("day_name", t.day_name("date"))


def weekday_totals(df: DataFrame, keys: Sequence[str] = ("community_code",), decimals: int | None = None) -> DataFrame:
    """Total per key and day name, from the daily totals."""
    daily = daily_with_name(df, keys, decimals)
    return daily.groupBy(*keys, "day_name").agg(total("total_active_kw", decimals).alias("sum_active_kw"))


def weekday_pivot(df: DataFrame, key: str = "community_code", decimals: int | None = None) -> DataFrame:
    """One row per key, one column per day name, Monday first."""
    wide = weekday_totals(df, [key], decimals).groupBy(key).pivot("day_name", list(t.DAY_NAMES))
    return wide.agg(F.max("sum_active_kw"))


def month_pivot(df: DataFrame, codes: Sequence[str], key: str = "community_code", decimals: int | None = None) -> DataFrame:
    """One row per month, one column per code."""
    monthly = rollup(df, "month", [key], decimals=decimals)
    return monthly.groupBy("month_start").pivot(key, list(codes)).agg(F.max("total_active_kw"))


def multigrain(df: DataFrame, labels: DataFrame | None = None, decimals: int | None = None) -> DataFrame:
    """15-minute totals per community beside their hour, day, week and month totals.

    The coarser totals are window sums over the small 15-minute frame, so the
    readings are scanned once; the largest window group is one community-month
    (2,976 rows), whatever the number of readings.  Hours and days nest in
    months, so those three windows share one shuffle and one sort.
    """
    key = "community_code"
    slots = rollup(df, "15min", [key], decimals=decimals).where(F.col(key).isNotNull())
    base = slots.withColumn("__hour", t.slot_start("datetime_15min", 60))
    base = base.withColumns(
        {
            "__date": F.to_date("datetime_15min"),
            "__week": t.week_start("datetime_15min"),
            "__month": t.month_start("datetime_15min"),
        }
    )
    nesting = {
        "hour": ["__month", "__date", "__hour"],
        "day": ["__month", "__date"],
        "month": ["__month"],
        "week": ["__week"],
    }
    for name, cols in nesting.items():
        w = Window.partitionBy(key, *cols)
        base = base.withColumn(f"{name}_total_active_kw", total("total_active_kw", decimals, over=w))
    base = base.withColumns(
        {
            "day_of_week": t.dow_mon0("__date"),
            "hour_of_day": F.hour("datetime_15min"),
            "quarter_of_hour": t.quarter_of_hour("datetime_15min"),
        }
    )
    if labels is None:
        from .encode import label_codes

        labels = label_codes(slots, key, "community_code_label", through="total_active_kw")
    return base.join(labels, key, "left").select(
        key,
        "community_code_label",
        "datetime_15min",
        "total_active_kw",
        "day_total_active_kw",
        "hour_total_active_kw",
        "week_total_active_kw",
        "month_total_active_kw",
        "day_of_week",
        "hour_of_day",
        "quarter_of_hour",
    )
