"""Forecasts: one row per 15-minute slot of [start, end), total over all clients."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import timeparts as t
from ..functions.numeric import mean
from ..operators import profile as p
from ..operators.grid import slot_grid
from ..operators.lags import lagged_demand, source_slot
from ..operators.quality import impute_medians
from ..operators.rollup import rollup
from ..session import materialize, store
from .boosting import SCORED, BoostingSettings, boosted_forecast, fit_boosting, predict_boosting
from .features import ALL_FEATURES, DEMAND_LAGS, TARGET, demand_series, feature_matrix, prediction_rows, training_rows


def _minus_days(stamp: str, days: int) -> str:
    return t.stamp_text(datetime.fromisoformat(stamp) - timedelta(days=days))


def before(meter: DataFrame, stamp: str, ts: str = "datetime_local") -> DataFrame:
    """Readings before a stamp, filtered on the raw column so that files can be skipped."""
    return meter.where(F.col(ts) < t.ntz(t.stamp_text(stamp)))


def day_ahead_history(meter: DataFrame, start: str) -> DataFrame:
    """Readings up to the day before yesterday: the last full day known when day `start` is forecast."""
    return before(meter, _minus_days(t.stamp_text(start)[:10], 1))


def naive_forecast(
    meter: DataFrame, start: str, end: str, day_by_day: bool = False, availability_lag_days: int = 1, decimals: int | None = None
) -> DataFrame:
    """The latest known slot of the same weekday and time; the mean of all known slots where that is missing, else 0.

    Nothing from the period is read, and nothing younger than `availability_lag_days`
    days before a day of it; 1 lets in all that precedes `start`.  With `day_by_day`
    the forecast is made anew each day instead: always the slot a week earlier,
    which for periods over seven days lies inside the period.
    """
    start, end = t.stamp_text(start), t.stamp_text(end)
    known_until = _minus_days(start, max(1, availability_lag_days) - 1)
    edge = max(start, _minus_days(end, 7)) if day_by_day else known_until
    totals = rollup(before(meter, edge), "15min", out="kw", decimals=decimals)
    # conditional rather than filtered: both uses of the totals share one scan
    past = F.when(F.col("datetime_15min") < t.ntz(start), F.col("kw")) if edge > start else F.col("kw")
    average = totals.select(mean(past, decimals)).scalar()
    grid = slot_grid(meter.sparkSession, start, end)
    wanted = grid.withColumn("__source", source_slot("datetime_15min", start, not day_by_day, availability_lag_days))
    known = totals.select(F.col("datetime_15min").alias("__source"), "kw")
    out = wanted.join(known, "__source", "left")
    return out.select("datetime_15min", F.coalesce("kw", average, F.lit(0.0)).alias("prediction"))


def median_forecast(
    meter: DataFrame, start: str, end: str, recent_days: int = 30, exact: bool = False, decimals: int | None = None
) -> DataFrame:
    """Median profile per community and weekday, summed over communities.

    History ends at the day before yesterday; the last `recent_days` are
    preferred where they hold the weekday.  A slot without any history is 0.
    """
    start, end = t.stamp_text(start), t.stamp_text(end)
    slots = rollup(day_ahead_history(meter, start), "15min", ["community_code"], decimals=decimals)
    base = p.median_baseline(slots, recent_from=_minus_days(start, recent_days)[:10], exact=exact)
    known = p.baseline_forecast(base, start, end, decimals=None if decimals is None else 6)
    out = slot_grid(meter.sparkSession, start, end).join(known, "datetime_15min", "left")
    return out.select("datetime_15min", F.coalesce("prediction", F.lit(0.0)).alias("prediction"))


def gbm_forecast(
    meter: DataFrame,
    start: str,
    end: str,
    weather: DataFrame,
    degrees: DataFrame,
    feeds: Mapping[str, DataFrame],
    calendar: DataFrame,
    settings: BoostingSettings = SCORED,
    seeds: Sequence[int] | None = None,
    availability_lag_days: int = 1,
    decimals: int | None = None,
) -> DataFrame:
    """Boosted trees on the feature matrix, trained on the slots before `start`; the scored settings unless told otherwise.

    Readings from `end` on are not read: the filter is on the raw column and reaches the files.
    """
    start, end = t.stamp_text(start), t.stamp_text(end)
    demand = demand_series(before(meter, end), decimals)
    matrix = feature_matrix(demand, weather, degrees, feeds, calendar, start, end, availability_lag_days, decimals)
    return boosted_forecast(matrix, start, end, settings, seeds=seeds)


def recursive_forecast(
    meter: DataFrame,
    start: str,
    end: str,
    weather: DataFrame,
    degrees: DataFrame,
    feeds: Mapping[str, DataFrame],
    calendar: DataFrame,
    settings: BoostingSettings = SCORED,
    decimals: int | None = None,
) -> DataFrame:
    """Boosted trees day by day: what is predicted for a day is the demand that the lags of later days look back on.

    No reading from `start` on is used. The model is fitted once, on the slots before `start`; each day then takes its
    lags from the readings and the days predicted so far, which are stored, so a lost executor costs no day anew. Slots with a lag that
    is missing take its training median.
    """
    start, end = t.stamp_text(start), t.stamp_text(end)
    demand = materialize(demand_series(before(meter, start), decimals))
    matrix = materialize(feature_matrix(demand, weather, degrees, feeds, calendar, start, end, decimals=decimals))
    train = materialize(training_rows(matrix, start))
    model = fit_boosting(train, settings=settings)
    known = prediction_rows(matrix, start, end).drop(TARGET, *DEMAND_LAGS)
    series, days = demand.select("datetime_15min", TARGET), []
    first = start
    while first < end:
        last = min(end, _minus_days(f"{first[:10]} 00:00:00", -1))
        grid = slot_grid(meter.sparkSession, first, last)
        lags = lagged_demand(series, grid).where(t.in_period("datetime_15min", first, last)).drop(TARGET)
        rows = known.where(t.in_period("datetime_15min", first, last)).join(lags, "datetime_15min")
        days.append(store(predict_boosting(model, impute_medians(rows, train, ALL_FEATURES))))
        series = series.unionByName(days[-1].withColumnRenamed("prediction", TARGET))
        first = last
    return reduce(DataFrame.unionByName, days) if days else slot_grid(meter.sparkSession, start, end).withColumn("prediction", F.lit(0.0))


MODELS: dict[str, Callable[..., DataFrame]] = {"naive": naive_forecast, "median": median_forecast, "gbt": gbm_forecast, "gbt_recursive": recursive_forecast}


def forecast(meter: DataFrame, start: str, end: str, model: str | Callable[..., DataFrame] = "naive", **options) -> DataFrame:
    """The forecast contract: (datetime_15min, prediction), one row per slot of [start, end)."""
    run = MODELS[model] if isinstance(model, str) else model
    out = run(meter, t.stamp_text(start), t.stamp_text(end), **options)
    return out.select(F.col("datetime_15min").cast("timestamp_ntz"), F.col("prediction").cast("double"))
