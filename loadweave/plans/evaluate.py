"""Hold-out evaluation and error diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import timeparts as t
from ..functions.numeric import mean, percent, ratio, total
from ..operators.rollup import rollup


def actuals(meter: DataFrame, start: str, end: str, decimals: int | None = None) -> DataFrame:
    """15-minute totals of [start, end), the period being applied to the raw column."""
    rows = meter.where(t.in_period("datetime_local", start, end))
    return rollup(rows, "15min", out="actual", decimals=decimals)


def matched(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """Slots with both a prediction and an actual, with error and percentage error."""
    both = predictions.join(actual, "datetime_15min").select("datetime_15min", "prediction", "actual")
    error = F.col("prediction") - F.col("actual")
    return both.withColumns({"error": error, "pct_error": percent(error, F.col("actual"))})


def _mae(decimals):
    return mean(F.abs("error"), decimals).alias("mae")


def holdout_mae(pairs: DataFrame, decimals: int | None = None) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("matched"), _mae(decimals))


def accuracy(pairs: DataFrame, decimals: int | None = None, by: str | None = None) -> DataFrame:
    """MAE and R2 over all slots, or per value of `by`."""
    sse = F.sum(F.pow("error", F.lit(2.0)))
    sst = F.var_pop("actual") * F.count("actual")
    return pairs.groupBy(*([by] if by else [])).agg(_mae(decimals), (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"))


def bias_summary(pairs: DataFrame, decimals: int | None = None) -> DataFrame:
    """Means, bias, MAE, ranges and sample deviations of actual and predicted load."""
    out = pairs.agg(
        mean("actual", decimals).alias("actual_mean"),
        mean("prediction", decimals).alias("prediction_mean"),
        mean("error", decimals).alias("bias"),
        _mae(decimals),
        F.min("actual").alias("actual_min"),
        F.max("actual").alias("actual_max"),
        F.min("prediction").alias("prediction_min"),
        F.max("prediction").alias("prediction_max"),
        F.stddev("actual").alias("actual_std"),
        F.stddev("prediction").alias("prediction_std"),
    )
    return out.withColumn("bias_pct", percent(F.col("bias"), F.col("actual_mean")))


def _means_by(pairs: DataFrame, key, name: str, decimals) -> DataFrame:
    out = pairs.groupBy(key.alias(name)).agg(
        mean("actual", decimals).alias("actual_mean"), mean("prediction", decimals).alias("prediction_mean")
    )
    out = out.withColumn("error_mean", F.col("prediction_mean") - F.col("actual_mean"))
    return out.withColumn("error_pct", percent(F.col("error_mean"), F.col("actual_mean")))


def error_by_hour(pairs: DataFrame, decimals: int | None = None) -> DataFrame:
    return _means_by(pairs, F.hour("datetime_15min"), "hour", decimals)


def error_by_weekday(pairs: DataFrame, decimals: int | None = None) -> DataFrame:
    """Monday = 0 .. Sunday = 6."""
    return _means_by(pairs, t.dow_mon0("datetime_15min"), "day_of_week", decimals)


def daily_error(pairs: DataFrame, decimals: int | None = None) -> DataFrame:
    return pairs.groupBy(F.to_date("datetime_15min").alias("date")).agg(
        _mae(decimals),
        mean("error", decimals).alias("bias"),
        mean("pct_error", decimals).alias("pct_bias"),
        mean("actual", decimals).alias("actual_mean"),
    )


def daily_error_summary(daily: DataFrame, decimals: int | None = None) -> DataFrame:
    """Spread of the daily percentage bias and the number of days of either sign."""
    return daily.agg(
        F.count(F.lit(1)).alias("days"),
        mean("pct_bias", decimals).alias("pct_bias_mean"),
        F.stddev("pct_bias").alias("pct_bias_std"),
        F.min("pct_bias").alias("pct_bias_min"),
        F.max("pct_bias").alias("pct_bias_max"),
        F.count_if(F.col("pct_bias") > 0).alias("positive_days"),
        F.count_if(F.col("pct_bias") < 0).alias("negative_days"),
    )


def elapsed_days(pairs: DataFrame, out: str = "days_from_start") -> DataFrame:
    """Whole 24-hour periods since the first matched slot."""
    first = pairs.select(F.min("datetime_15min")).scalar()
    return pairs.withColumn(out, F.extract(F.lit("DAY"), F.col("datetime_15min") - first).cast("int"))


def weekly_drift(pairs: DataFrame, decimals: int | None = None) -> DataFrame:
    """Percentage bias and MAE by week since the first matched slot (0-based)."""
    week = F.floor(F.col("days_from_start") / F.lit(7.0)).alias("week")
    return elapsed_days(pairs).groupBy(week).agg(mean("pct_error", decimals).alias("pct_bias"), _mae(decimals))


def verdict(daily: DataFrame, weekly: DataFrame, max_std: float = 5.0) -> DataFrame:
    """Uniform bias (a calibration matter) or possible overfitting.

    Uniform means that all days err to the same side and the daily percentage
    bias varies by less than `max_std`; the drift between the first and the
    last week is reported beside it.
    """
    spread = daily.agg(
        F.bool_and(F.col("bias") < 0).alias("all_under"),
        F.bool_and(F.col("bias") > 0).alias("all_over"),
        F.stddev("pct_bias").alias("bias_std"),
    )
    drift = weekly.select(
        F.abs(F.max_by("pct_bias", "week") - F.min_by("pct_bias", "week")).alias("drift")
    ).scalar()
    uniform = (F.col("all_under") | F.col("all_over")) & (F.col("bias_std") < max_std)
    label = F.when(uniform, "uniform bias").otherwise("possible overfitting")
    return spread.select("all_under", "all_over", "bias_std", drift.alias("drift"), label.alias("verdict"))
