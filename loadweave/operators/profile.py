"""Daily load profiles: 96 quarter-hours per day as an array, wide only at the edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import timeparts as t
from ..functions.numeric import mean, total
from .rollup import rollup

SLOTS = t.SLOTS_PER_DAY


def slot_parts(df15: DataFrame, ts: str = "datetime_15min") -> DataFrame:
    """Add date, interval index and day parts (Sunday = 1 coding)."""
    df = df15.withColumns({"date": F.to_date(ts), "interval_idx": t.interval_idx(ts)})
    return df.withColumns(
        {
            "day_of_week": t.dow_sun1("date"),
            "month": F.month("date"),
            "is_weekend": t.is_weekend("date"),
        }
    )


def daily_arrays(
    df15: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "datetime_15min",
    value: str = "total_active_kw",
    fill: float | None = None,
    out: str = "profile",
) -> DataFrame:
    """One row per (keys, date) with an array of 96 values.

    Slots without a row become `fill` (null if not given).  A group gathers at
    most 96 rows, since `df15` is unique per slot.
    """
    src = df15.select(*keys, F.to_date(ts).alias("date"), t.interval_idx(ts).alias("i"), F.col(value).alias("v"))
    pairs = F.collect_list(F.struct("i", "v")).alias("__l")
    return src.groupBy(*keys, "date").agg(pairs).select(*keys, "date", _dense("__l", fill).alias(out))


def _dense(pairs: str, fill: float | None) -> Column:
    """Unordered (i, v) pairs to 96 values in slot order.

    The values are joined with runs of `fill` between them, so the work grows
    with the filled slots and not with 96 look-ups per day.
    """
    gap = F.lit(fill).cast("double")
    ordered = F.sort_array(pairs)

    def piece(x: Column, k: Column) -> Column:
        before = F.coalesce(F.get(ordered, k - 1)["i"], F.lit(-1))
        return F.concat(F.array_repeat(gap, x["i"] - before - 1), F.array(F.coalesce(x["v"], gap)))

    last = F.get(ordered, F.size(pairs) - 1)["i"]
    padded = F.concat(F.flatten(F.transform(ordered, piece)), F.array_repeat(gap, F.lit(SLOTS - 1) - last))
    whole = F.size(pairs) == SLOTS
    if fill is not None:
        whole = whole & ~F.exists(pairs, lambda x: x["v"].isNull())
    return F.when(whole, ordered["v"]).otherwise(padded)


def to_wide(profiles: DataFrame, profile: str = "profile", prefix: str = "", suffix: str = "") -> DataFrame:
    """Array column to 96 columns named by slot.

    Set spark.sql.codegen.hugeMethodLimit to 8000 where this runs on many rows:
    above that size HotSpot interprets the generated method, at a third of the speed.
    """
    rest = [c for c in profiles.columns if c != profile]
    cols = [F.col(profile)[i].alias(f"{prefix}{i}{suffix}") for i in range(SLOTS)]
    return profiles.select(*rest, *cols)


def to_long(profiles: DataFrame, profile: str = "profile", value: str = "kw") -> DataFrame:
    """Array column to (interval_idx, value) rows."""
    rest = [c for c in profiles.columns if c != profile]
    return profiles.select(*rest, F.posexplode(profile).alias("interval_idx", value))


def profile_rows(profiles: DataFrame, profile: str = "profile", out_ts: str = "datetime_15min", value: str = "prediction") -> DataFrame:
    """Array column to one row per slot with its timestamp."""
    long = to_long(profiles, profile, value)
    offset = F.make_dt_interval(F.lit(0), F.lit(0), F.col("interval_idx") * t.SLOT_MINUTES, F.lit(0))
    return long.withColumn(out_ts, F.col("date").cast("timestamp_ntz") + offset)


def wide_profiles(
    readings: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "datetime_local",
    value: str = "active_kw",
    fill: float | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """Profile pivot of the readings: columns "0".."95" per (keys, date).

    Only (key, slot, total) rows are shuffled.  A built-in pivot would send a
    96-wide row for every one of them.
    """
    slots = rollup(readings, "15min", keys, ts, value, "__kw", decimals)
    return to_wide(daily_arrays(slots, keys, value="__kw", fill=fill))


def feed_profile(feeds: DataFrame, ts: str = "datetime_local", measures: dict[str, str] | None = None) -> DataFrame:
    """Three feeds pivoted together: 288 columns 0_d, 0_p, 0_w .. 95_w per date, gaps as 0.

    A slot that the feeds repeat keeps its smallest value.
    """
    measures = measures or {"d": "demand_fc", "p": "pv_fc", "w": "wind_fc"}
    src = feeds.select(F.to_date(ts).alias("date"), t.interval_idx(ts).alias("i"), *measures.values())
    slot = src.groupBy("date", "i").agg(*[F.min(c).alias(s) for s, c in measures.items()])
    packed = slot.groupBy("date").agg(
        F.map_from_entries(F.collect_list(F.struct("i", F.struct(*measures).alias("v")))).alias("__m")
    )
    cols = [
        F.coalesce(F.col("__m")[i][s], F.lit(0.0)).alias(f"{i}_{s}") for i in range(SLOTS) for s in measures
    ]
    return packed.select("date", *cols)


def daily_conditions(df15: DataFrame, keys: Sequence[str] = (), decimals: int | None = None, full: bool = True) -> DataFrame:
    """Day parts and the feeds' daily mean, highest and lowest values.

    `full=False` gives the three-mean form used beside per-client profiles.
    """
    day = slot_parts(df15)
    aggs = [F.min(c).alias(c) for c in ("day_of_week", "month")]
    if full:
        aggs += [
            F.min("is_weekend").alias("is_weekend"),
            mean("demand_fc", decimals).alias("demand_fc_mean"),
            F.max("demand_fc").alias("demand_fc_max"),
            F.min("demand_fc").alias("demand_fc_min"),
            mean("pv_fc", decimals).alias("pv_fc_mean"),
            F.max("pv_fc").alias("pv_fc_max"),
            mean("wind_fc", decimals).alias("wind_fc_mean"),
            F.max("wind_fc").alias("wind_fc_max"),
        ]
    else:
        aggs += [mean(f"{f}_fc", decimals).alias(f"{f}_fc_mean") for f in ("demand", "pv", "wind")]
    return day.groupBy(*keys, "date").agg(*aggs)


def conditioned_profiles(df15: DataFrame, keys: Sequence[str] = (), value: str = "total_active_kw", decimals: int | None = None, full: bool = True, complete: bool | None = None) -> DataFrame:
    """Profile and conditions of each day in one grouping (instead of two and a join).

    Days lacking any of the 96 slots are left out when `complete` (as for the full
    form, the total series); otherwise their gaps count as 0.  Conditions that are missing count
    as 0 in both forms.
    """
    complete = full if complete is None else complete
    day = slot_parts(df15)
    parts = ["day_of_week", "month", "is_weekend"] if full else ["day_of_week", "month"]
    pairs = F.collect_list(F.struct(F.col("interval_idx").alias("i"), F.col(value).alias("v"))).alias("__l")
    conditions = {f"{f}_fc_mean": mean(f"{f}_fc", decimals) for f in ("demand", "pv", "wind")}
    if full:
        conditions |= {f"{f}_fc_max": F.max(f"{f}_fc") for f in ("demand", "pv", "wind")} | {"demand_fc_min": F.min("demand_fc")}
    out = day.groupBy(*keys, "date").agg(pairs, *[F.min(c).alias(c) for c in parts], *[v.alias(n) for n, v in conditions.items()])
    out = out.withColumn("profile", _dense("__l", None if complete else 0.0)).drop("__l").fillna(0.0, subset=list(conditions))
    return out.where(~F.exists("profile", lambda v: v.isNull())) if complete else out


def median_baseline(
    df15: DataFrame,
    key: str = "community_code",
    value: str = "total_active_kw",
    recent_from: str | None = None,
    exact: bool = False,
    gaps_as_zero: bool = True,
) -> DataFrame:
    """Median load per (community, weekday, slot), preferring days from `recent_from` on.

    Both medians come out of one grouping in long form; a group holds one value
    per week of history.  `exact=False` takes an observed value (the lower
    middle one); `exact=True` interpolates.  A slot missing on an observed day
    counts as zero load unless `gaps_as_zero` is off.
    """
    days = daily_arrays(df15, [key], value=value, fill=0.0 if gaps_as_zero else None)
    long = to_long(days, value="kw").withColumn("day_of_week", t.dow_sun1("date"))

    def median(col):
        return F.percentile(col, 0.5) if exact else F.percentile_approx(col, 0.5)

    aggs = [median(F.col("kw")).alias("hist_global")]
    if recent_from:
        recent = F.when(F.col("date") >= F.lit(recent_from).cast("date"), F.col("kw"))
        aggs.append(median(recent).alias("hist_recent"))
    else:
        aggs.append(F.first(F.lit(None).cast("double")).alias("hist_recent"))
    out = long.groupBy(key, "day_of_week", "interval_idx").agg(*aggs)
    return out.withColumn("hist", F.coalesce("hist_recent", "hist_global"))


def attach_baseline(df15: DataFrame, baseline: DataFrame, key: str = "community_code") -> DataFrame:
    """Each slot beside the baseline of its community, weekday and slot (0 where there is none)."""
    rows = slot_parts(df15).drop("month", "is_weekend")
    out = rows.join(baseline.select(key, "day_of_week", "interval_idx", "hist"), [key, "day_of_week", "interval_idx"], "left")
    return out.fillna(0.0, subset=["hist"])


def baseline_forecast(baseline: DataFrame, start: str, end: str, key: str = "community_code", value: str = "hist", decimals: int | None = None) -> DataFrame:
    """Sum of the communities' baselines on every slot in [start, end).

    A weekday the community never saw takes the mean of its other weekdays.
    Grouping the (at most seven) weekdays of a slot first makes the forecast
    days a plain explode: no join, no grid.
    """
    week = baseline.groupBy(key, "interval_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("day_of_week", F.col(value).alias("v")))).alias("__by_dow"),
        mean(value, decimals).alias("__mean"),
    )
    days = F.sequence(F.lit(t.stamp_text(start)[:10]).cast("date"), F.lit(end).cast("timestamp_ntz").cast("date"))
    rows = week.withColumn("date", F.explode(days))
    kw = F.coalesce(F.col("__by_dow")[t.dow_sun1("date")], F.col("__mean"), F.lit(0.0))
    offset = F.make_dt_interval(F.lit(0), F.lit(0), F.col("interval_idx") * t.SLOT_MINUTES, F.lit(0))
    rows = rows.select(key, (F.col("date").cast("timestamp_ntz") + offset).alias("datetime_15min"), kw.alias("kw"))
    return bottom_up(rows.where(t.in_period("datetime_15min", start, end)), "kw", decimals=decimals)


def feed_arrays(feeds: DataFrame, ts: str = "datetime_local", measures: Sequence[str] = ("demand_fc", "pv_fc", "wind_fc")) -> DataFrame:
    """(date, feeds): one array of 96 x measures per day, slot by slot, gaps as 0."""
    src = feeds.select(F.to_date(ts).alias("date"), t.interval_idx(ts).alias("i"), *measures)
    slot = src.groupBy("date", "i").agg(*[F.min(c).alias(c) for c in measures])
    packed = slot.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("i", F.array(*measures).alias("v")))).alias("__m"))
    none = F.array(*[F.lit(None).cast("double") for _ in measures])
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.col("__m")[i], none)))
    return packed.select("date", F.transform(flat, lambda v: F.coalesce(v, F.lit(0.0))).alias("feeds"))


def profile_matrix(df15: DataFrame, baseline: DataFrame, feeds: DataFrame, labels: DataFrame, key: str = "community_code", value: str = "total_active_kw") -> DataFrame:
    """Training rows of a profile model: per community and day, the 96 loads, the
    96 baseline values, the feeds of the day, and the calendar and label parts.

    Days without any feed row drop out.  Everything stays in arrays; widen at
    the edge with `to_wide`.
    """
    days = daily_arrays(df15, [key], value=value, fill=0.0).withColumn("day_of_week", t.dow_sun1("date"))
    hist = F.sort_array(F.collect_list(F.struct("interval_idx", "hist")))["hist"]
    base = baseline.groupBy(key, "day_of_week").agg(hist.alias("hist"))
    zeros = F.array_repeat(F.lit(0.0), SLOTS)
    out = days.join(base, [key, "day_of_week"], "left").withColumn("hist", F.coalesce("hist", zeros))
    out = out.join(feed_arrays(feeds), "date").join(labels, key, "left")
    return out.withColumns({"month": F.month("date"), "is_weekend": t.is_weekend("date")})


def feeds_for_days(days: DataFrame, feeds: DataFrame, train: DataFrame) -> DataFrame:
    """The feeds of each day; a day without any takes the medians over the training rows.

    `train` has a date per training row, so a day with more communities weighs more.
    """
    weights = train.groupBy("date").agg(F.count(F.lit(1)).alias("__w"))
    long = feed_arrays(feeds).join(weights, "date").select("__w", F.posexplode("feeds").alias("pos", "v"))
    medians = long.groupBy("pos").agg(F.percentile("v", 0.5, F.col("__w")).alias("m"))
    typical = medians.select(F.sort_array(F.collect_list(F.struct("pos", "m")))["m"]).scalar()
    return days.join(feed_arrays(feeds), "date", "left").withColumn("feeds", F.coalesce("feeds", typical))


def bottom_up(df: DataFrame, value: str, ts: str = "datetime_15min", out: str = "prediction", decimals: int | None = None) -> DataFrame:
    """Per-community values summed to one total per slot."""
    return df.groupBy(ts).agg(total(value, decimals).alias(out))


def weekday_lag_profiles(profiles: DataFrame, profile: str = "profile") -> DataFrame:
    """Each day's profile beside those 7 and 14 rows (days) earlier.

    The first 7 rows fall back to themselves for lag 7; the first 14 rows take
    the row max(i - 7, 0) for lag 14.  Only the dates are ranked in one place;
    the profiles move in one shuffle.
    """
    profiles = profiles.where(F.col("date").isNotNull())
    days = profiles.groupBy("date").agg(F.count(profile).alias("__n")).where("__n >= 0")
    ranked = days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))
    rows = profiles.join(ranked, "date")
    own, lag7, lag14 = (F.struct((F.col("i") + k).alias("p"), F.lit(k).alias("k")) for k in (0, 7, 14))
    # the first profile stands in for lag 14 on the first seven days
    early = F.when(F.col("i") == 0, F.transform(F.sequence(F.lit(0), F.lit(6)), lambda p: F.struct(p.alias("p"), F.lit(99).alias("k"))))
    targets = F.concat(F.array(own, lag7, lag14), F.coalesce(early, F.array().cast("array<struct<p:int,k:int>>")))
    sent = rows.select("date", F.col(profile).alias("v"), F.explode(targets).alias("m"))

    def pick(k, c="v"):
        return F.max_by(F.when(F.col("m.k") == k, F.col(c)), F.when(F.col("m.k") == k, F.lit(1)))

    out = sent.groupBy(F.col("m.p").alias("i")).agg(
        F.max(F.when(F.col("m.k") == 0, F.col("date"))).alias("date"),
        pick(0).alias(profile), pick(7).alias("l7"), pick(14).alias("l14"), pick(99).alias("l0"),
    )
    return out.where(F.col("date").isNotNull()).select(
        "date",
        profile,
        F.coalesce("l7", profile).alias("lag7"),
        F.coalesce("l14", "l7", "l0").alias("lag14"),
    )
