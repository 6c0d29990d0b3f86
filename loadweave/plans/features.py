"""The day-ahead feature matrix: 12 core and 11 seasonal features per slot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import timeparts as t
from ..functions.timeparts import SLOTS_PER_DAY
from ..operators.feeds import feeds_slots, join_feeds
from ..operators.grid import carry, slot_grid
from ..operators.lags import lagged_demand, rolling_previous_week, row_index, row_lags
from ..operators.rollup import rollup
from ..operators.weather import daily_mean, spatial_mean

# fixed values: the names and the order of the features are the column contract
WEATHER = ("dew_point_2m", "temperature_2m", "cloud_cover", "relative_humidity_2m")
FEEDS = ("demand_forecast", "pv_forecast", "wind_forecast")
DEGREES = ("hdd_hourly", "cdd_hourly")

CORE_FEATURES = (
    "dew_point_2m",
    "temperature_2m",
    "hdd_hourly",
    "cdd_hourly",
    "pv_forecast",
    "cloud_cover",
    "wind_forecast",
    "relative_humidity_2m",
    "demand_forecast",
    "demand_lag_7d",
    "demand_lag_1d",
    "rolling_mean_7d",
)
SEASONAL_FEATURES = (
    "is_weekend",
    "is_holiday",
    "hour",
    "day_of_week",
    "month",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "month_sin",
    "month_cos",
)
#: The features that look back on the demand itself
DEMAND_LAGS = ("demand_lag_7d", "demand_lag_1d", "rolling_mean_7d")
ALL_FEATURES = CORE_FEATURES + SEASONAL_FEATURES
TARGET = "demand_kw"


def seasonal(df: DataFrame, ts: str = "datetime_15min") -> DataFrame:
    """Hour of day as a fraction, weekday (Monday = 0), month, and their circles."""
    df = df.withColumns({"hour": t.hour_fraction(ts), "day_of_week": t.dow_mon0(ts), "month": F.month(ts)})
    out = {}
    for name, col, period in (("hour", "hour", 24), ("dow", "day_of_week", 7), ("month", "month", 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = t.cyclic(F.col(col), period)
    return df.withColumns(out)


def fill_calendar_flags(df: DataFrame, ts: str = "datetime_15min") -> DataFrame:
    """Missing weekend flags follow from the date; missing holiday flags are 0."""
    cols = {"is_weekend": F.coalesce(F.col("is_weekend"), t.is_weekend(ts))}
    cols |= {c: F.coalesce(F.col(c), F.lit(0)) for c in ("is_holiday", "is_national_holiday")}
    return df.withColumns(cols)


def weather_slots(weather: DataFrame, values: Sequence[str] = WEATHER, decimals: int | None = None) -> DataFrame:
    """Mean over communities per hour, carried to 15 minutes."""
    return carry(spatial_mean(weather, values, decimals=decimals), "datetime_local", list(values))


def demand_series(meter: DataFrame, decimals: int | None = None) -> DataFrame:
    return rollup(meter, "15min", out=TARGET, decimals=decimals)


def join_exogenous(
    axis: DataFrame,
    weather: DataFrame,
    degrees: DataFrame,
    feeds: Mapping[str, DataFrame],
    calendar: DataFrame,
    decimals: int | None = None,
) -> DataFrame:
    """Weather, feeds, degree-hours and calendar flags onto a 15-minute axis.

    All sides are time axes of the same few rows per day; none grows with the
    number of clients, and Spark chooses broadcast or sort-merge by their size.
    """
    out = axis.join(weather_slots(weather, decimals=decimals), "datetime_15min", "left")
    out = out.join(feeds_slots(feeds), "datetime_15min", "left")
    out = out.withColumn("date", F.to_date("datetime_15min"))
    out = out.join(daily_mean(degrees, DEGREES, decimals=decimals), "date", "left")
    flags = calendar.select("date", "is_weekend", "is_holiday", "is_national_holiday")
    return fill_calendar_flags(out.join(flags, "date", "left")).drop("date")


def feature_matrix(
    demand: DataFrame,
    weather: DataFrame,
    degrees: DataFrame,
    feeds: Mapping[str, DataFrame],
    calendar: DataFrame,
    start: str,
    end: str,
    availability_lag_days: int = 1,
    decimals: int | None = None,
) -> DataFrame:
    """Features and target on every observed slot before `start` and every slot of [start, end).

    `demand` is the 15-minute total.  The predicted period always has its full
    grid, whether or not readings exist for it.
    """
    grid = slot_grid(demand.sparkSession, start, end)
    lagged = lagged_demand(demand, grid, availability_lag_days=availability_lag_days, decimals=decimals)
    axis = lagged.where(F.col("datetime_15min") < t.ntz(end))
    out = seasonal(join_exogenous(axis, weather, degrees, feeds, calendar, decimals))
    return out.select("datetime_15min", TARGET, *ALL_FEATURES)


# fixed values: the columns of the explored matrix
LAG_FEATURES = (
    "lag_1d",
    "lag_7d",
    "lag_2d",
    "lag_3d",
    "rolling_mean_7d",
    "rolling_std_7d",
    "hour",
    "minute",
    "day_of_week",
    "day_of_month",
    "month",
    "is_weekend",
    "demand_forecast",
    "pv_forecast",
    "wind_forecast",
)


def lag_matrix(demand: DataFrame, feeds: Mapping[str, DataFrame], decimals: int | None = None) -> DataFrame:
    """The explored matrix: four row lags, the previous week's mean and deviation,
    time parts (Sunday = 1) and the feeds on their exact stamps; complete rows only.

    Its rolling window reaches to the slot before, which a day-ahead forecast
    cannot know; `feature_matrix` is the one for forecasting.
    """
    ts = "datetime_15min"
    indexed = row_index(demand.select(ts, TARGET), ts, TARGET)
    rolled = rolling_previous_week(indexed, ts, TARGET, decimals)
    day = SLOTS_PER_DAY
    lagged = row_lags(rolled, {"lag_1d": day, "lag_7d": 7 * day, "lag_2d": 2 * day, "lag_3d": 3 * day}, ts, TARGET)
    timed = lagged.withColumns(
        {
            "hour": F.hour(ts),
            "minute": F.minute(ts),
            "day_of_week": t.dow_sun1(ts),
            "day_of_month": F.dayofmonth(ts),
            "month": F.month(ts),
            "is_weekend": t.is_weekend(ts),
        }
    )
    return join_feeds(timed, feeds).select(ts, TARGET, *LAG_FEATURES).dropna()


# fixed values: time parts among the candidates
CANDIDATE_TIMES = ("hour", "day_of_week", "month", "is_weekend", "hour_sin", "hour_cos")


def candidate_matrix(
    demand: DataFrame,
    weather: DataFrame,
    stations: DataFrame,
    degrees: DataFrame,
    feeds: Mapping[str, DataFrame],
    hourly: Sequence[str] = WEATHER,
    daily: Sequence[str] = ("tmed", "prec", "velmedia"),
    decimals: int | None = None,
) -> DataFrame:
    """Every candidate of the feature selection on the observed slots: hourly weather carried to
    15 minutes, the day's station and degree-hour means, the feeds on their exact stamps, time parts.

    `hourly` and `daily` name the variables that the sources have; `stations` is clean, with a row per
    station and `fecha`.  Slots without a value stay null.
    """
    ts = "datetime_15min"
    out = demand.join(weather_slots(weather, hourly, decimals), ts, "left").withColumn("date", F.to_date(ts))
    out = out.join(daily_mean(stations, daily, "fecha", decimals), "date", "left")
    out = out.join(daily_mean(degrees, DEGREES, decimals=decimals), "date", "left").drop("date")
    out = seasonal(join_feeds(out, feeds)).withColumn("is_weekend", t.is_weekend(ts))
    return out.select(ts, TARGET, *hourly, *daily, *DEGREES, *feeds, *CANDIDATE_TIMES)


def training_rows(matrix: DataFrame, start: str, features: Sequence[str] = ALL_FEATURES) -> DataFrame:
    """Complete rows before the predicted period."""
    return matrix.where(F.col("datetime_15min") < t.ntz(start)).dropna(subset=[*features, TARGET])


def prediction_rows(matrix: DataFrame, start: str, end: str) -> DataFrame:
    return matrix.where(t.in_period("datetime_15min", start, end))
