"""Lags and rolling statistics, by clock and by row, without global windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import timeparts as t
from ..functions.numeric import mean, total


def scatter(
    df: DataFrame, position: str, copies: Mapping[str, tuple[str, Column]], keys: Sequence[str] = (), carry: Sequence[str] = ()
) -> DataFrame:
    """Move values to other positions of the same series in one shuffle.

    `copies` maps an output name to (value column, target position).  Each row
    sends its values to their targets and a grouping on the target gathers
    them, so k lags cost one shuffle rather than k self-joins.  Only positions
    that exist in `df` come back (left-join semantics); `carry` columns stay
    with their own row.  Where `df` repeats a position, the row with the largest
    value (of the first copy, then of the other columns) stands for all.
    """
    first = [source for source, _ in copies.values() if source in carry]
    carry_order = list(dict.fromkeys([*first, *carry]))
    names = list(copies)
    own = F.struct(F.col(position).alias("p"), F.lit(-1).alias("k"), F.lit(None).cast("double").alias("v"))
    sent = [
        F.struct(target.alias("p"), F.lit(i).alias("k"), F.col(source).cast("double").alias("v"))
        for i, (source, target) in enumerate(copies.values())
    ]
    rows = df.select(*keys, *carry, F.explode(F.array(own, *sent)).alias("__m"))
    is_own = F.col("__m.k") == -1
    # one struct, so that the columns of two rows are never mixed
    one = F.col(carry_order[0]) if len(carry_order) == 1 else F.struct(*carry_order)
    aggs = [F.max(F.when(is_own, one)).alias("__own_row")] if carry else []
    aggs += [F.max(F.when(F.col("__m.k") == i, F.col("__m.v"))).alias(n) for i, n in enumerate(names)]
    out = rows.groupBy(*keys, F.col("__m.p").alias(position)).agg(F.count_if(is_own).alias("__own"), *aggs)
    own_row = [(F.col("__own_row") if len(carry) == 1 else F.col("__own_row")[c]).alias(c) for c in carry]
    return out.where("__own > 0").select(*keys, position, *own_row, *names)


def clock_lags(
    df: DataFrame, lags: Mapping[str, int], ts: str = "datetime_15min", value: str = "demand_kw", keys: Sequence[str] = ()
) -> DataFrame:
    """Value at t - d days for each {name: d}; null when that stamp is absent."""
    copies = {name: (value, t.shift_days(ts, days)) for name, days in lags.items()}
    rest = [c for c in df.columns if c not in (*keys, ts)]
    return scatter(df, ts, copies, keys, rest).select(*df.columns, *lags)


def row_index(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """Position of each row in its series (1-based, in time order).

    Rows are numbered inside their day and shifted by the number of rows on
    earlier days.  The running count sees one row per day, never the series.
    `value` is counted, and the day filtered, so that both branches have the
    same upstream aggregate and Spark reuses its shuffle.
    """
    src = df.withColumn("__day", F.to_date(ts)).where(F.col("__day").isNotNull())
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    n = F.count(value) + F.count_if(F.col(value).isNull())
    days = src.groupBy(*keys, "__day").agg(n.alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    offsets = days.select(*keys, "__day", F.coalesce(before, F.lit(0)).alias("__before"))
    in_day = F.row_number().over(Window.partitionBy(*keys, "__day").orderBy(ts))
    numbered = src.withColumn("__in_day", in_day).join(offsets, [*keys, "__day"])
    return numbered.select(*df.columns, (F.col("__before") + F.col("__in_day")).alias(out))


def _indexed(df: DataFrame, ts: str, value: str, keys: Sequence[str]) -> DataFrame:
    """The frame with its row index `rn`, numbered only if it is not yet."""
    return df if "rn" in df.columns else row_index(df, ts, value, keys)


def row_lags(
    df: DataFrame, lags: Mapping[str, int], ts: str = "datetime_15min", value: str = "total_kw", keys: Sequence[str] = ()
) -> DataFrame:
    """Value n rows back for each {name: n} (negative n looks ahead).

    Equal to a clock lag only while the series has no gap; `clock_lags` is the
    safe choice.  A frame that already has its index `rn` keeps it.
    """
    indexed = _indexed(df, ts, value, keys)
    copies = {name: (value, F.col("rn") + F.lit(n)) for name, n in lags.items()}
    rest = [c for c in df.columns if c not in (*keys, "rn")]
    return scatter(indexed, "rn", copies, keys, rest).select(*df.columns, *lags)


def next_day_target(df: DataFrame, ts: str = "datetime_15min", value: str = "total_active_kw", key: str = "community_code") -> DataFrame:
    """Per community, the value 96 rows ahead; rows without one are dropped."""
    out = row_lags(df, {"target": -t.SLOTS_PER_DAY}, ts, value, [key])
    return out.where(F.col("target").isNotNull())


def rolling_rows(
    df: DataFrame,
    aggregates: Mapping[str, tuple[str, str]],
    first: int,
    last: int,
    ts: str = "datetime_15min",
    value: str = "total_kw",
    keys: Sequence[str] = (),
    decimals: int | None = None,
) -> DataFrame:
    """Trailing ROWS frames [first, last] (first <= last <= 0) over each series.

    `aggregates` maps an output name to ("mean" | "std" | "count", column).
    The numbered series is cut into chunks as long as the frame; every row also
    goes to the following chunk as history, so a task holds at most two chunks
    of one series and the frames are complete.
    """
    if not first <= last <= 0:
        raise ValueError("the frame must end at or before the current row")
    size = max(1, -first)
    indexed = _indexed(df, ts, value, keys)
    chunk = F.floor((F.col("rn") - 1) / F.lit(size))
    copies = F.explode(F.array(F.struct(chunk.alias("c"), F.lit(True).alias("own")), F.struct((chunk + 1).alias("c"), F.lit(False).alias("own"))))
    w = Window.partitionBy(*keys, "__m.c").orderBy("rn").rowsBetween(first, last)
    build = {
        "mean": lambda c: mean(c, decimals, over=w),
        "std": lambda c: F.stddev(c).over(w),
        "count": lambda c: F.count(c).over(w),
    }
    cols = {name: build[kind](c) for name, (kind, c) in aggregates.items()}
    out = indexed.withColumn("__m", copies).withColumns(cols)
    return out.where("__m.own").select(*df.columns, *aggregates)


def rolling_previous_week(df: DataFrame, ts: str = "datetime_15min", value: str = "total_kw", decimals: int | None = None) -> DataFrame:
    """Mean and sample deviation of the 672 rows before the current one."""
    week = 7 * t.SLOTS_PER_DAY
    aggs = {"rolling_mean_7d": ("mean", value), "rolling_std_7d": ("std", value)}
    return rolling_rows(df, aggs, -week, -1, ts, value, decimals=decimals)


def rolling_week_inclusive(
    df: DataFrame, ts: str = "datetime_15min", value: str = "demand_kw", out: str = "rolling_mean_7d", decimals: int | None = None
) -> DataFrame:
    """Mean of the last 672 rows with the current one; null before 96 values are there."""
    week = 7 * t.SLOTS_PER_DAY
    rolled = rolling_rows(df, {"__mean": ("mean", value), "__n": ("count", value)}, -week + 1, 0, ts, value, decimals=decimals)
    ready = F.when(F.col("__n") >= t.SLOTS_PER_DAY, F.col("__mean"))
    return rolled.withColumn(out, ready).drop("__mean", "__n")


def lagged_demand(
    df: DataFrame,
    axis: DataFrame | None = None,
    ts: str = "datetime_15min",
    value: str = "demand_kw",
    availability_lag_days: int = 1,
    decimals: int | None = None,
) -> DataFrame:
    """Weekly lag, daily lag and the weekly mean shifted by a day, on the series' own slots or on `axis`.

    All three look back by the clock: a slot whose source stamp is missing gets
    null.  `availability_lag_days` is the age of the newest reading that may be
    used; 1 lets the previous day in, 2 keeps it out.  The weekly lag is the
    smallest whole number of weeks that is old enough.
    """
    near = max(1, availability_lag_days)
    far = 7 * -(-near // 7)
    rolled = rolling_week_inclusive(df.select(ts, value), ts, value, "__roll", decimals)
    copies = {
        "demand_lag_7d": (value, t.shift_days(ts, far)),
        "demand_lag_1d": (value, t.shift_days(ts, near)),
        "rolling_mean_7d": ("__roll", t.shift_days(ts, near)),
    }
    if axis is None:
        return scatter(rolled, ts, copies, carry=[value]).select(ts, value, *copies)
    # axis slots enter as rows without a reading; the grouping merges them with the observed ones
    slots = axis.select(ts, F.lit(None).cast("double").alias(value), F.lit(None).cast("double").alias("__roll"))
    both = rolled.select(ts, value, "__roll").unionByName(slots)
    return scatter(both, ts, copies, carry=[value]).select(ts, value, *copies)


def source_slot(ts: str, start: str, recursive: bool = True, availability_lag_days: int = 1) -> Column:
    """Slot whose reading a weekly-lag forecast copies.

    Predicting day by day and feeding each day back gives, in closed form,
    the latest same-weekday slot before `start`: 7 * ceil(h / 7) days back for
    the h-th day, and more if the days before `start` are not known yet.
    Without `recursive` it is simply 7 days back.
    """
    if not recursive:
        return t.shift_days(ts, -7)
    horizon = F.datediff(F.to_date(F.col(ts)), F.lit(t.stamp_text(start)[:10]).cast("date")) + max(1, availability_lag_days)
    weeks = F.ceil(horizon / F.lit(7.0)).cast("int")
    return F.col(ts) - F.make_dt_interval(weeks * 7, F.lit(0), F.lit(0), F.lit(0))
