from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.operators import calendar as cal, region
from loadweave.plans import boosting, evaluate as ev, features as ft, forecast as fc, linear, trees
from loadweave.sources import schemas, sinks

START = dt.datetime(2024, 1, 1)
SLOT = dt.timedelta(minutes=15)


@pytest.fixture(scope="module")
def meter(spark):
    """Three weeks of two communities with a daily shape."""
    rows = [
        (c, START + i * SLOT, "ab"[c], round(10 + 5 * math.sin(2 * math.pi * (i % 96) / 96) + c + (i // 96) % 7, 2))
        for i in range(21 * 96)
        for c in range(2)
    ]
    return spark.createDataFrame(rows, "client_id bigint, datetime_local timestamp_ntz, community_code string, active_kw double").cache()


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "datetime_15min timestamp_ntz, prediction double, actual double")
    return ev.matched(df.select("datetime_15min", "prediction"), df.select("datetime_15min", "actual"))


def test_contract_and_period_without_readings(meter):
    for model in ("naive", "median"):
        out = fc.forecast(meter, "2024-03-01 00:00:00", "2024-03-03 00:00:00", model)
        assert out.dtypes == [("datetime_15min", "timestamp_ntz"), ("prediction", "double")]
        assert out.count() == 2 * 96 == out.select("datetime_15min").distinct().count()
        assert out.where("prediction is null").count() == 0


def test_weekly_pattern_is_repeated_exactly(meter):
    out = fc.naive_forecast(meter, "2024-01-15 00:00:00", "2024-01-22 00:00:00", decimals=2)
    found = ev.holdout_mae(ev.matched(out, ev.actuals(meter, "2024-01-15 00:00:00", "2024-01-22 00:00:00", 2)), 6).first()
    assert found.matched == 7 * 96 and found.mae == 0.0


def test_forecasts_do_not_read_the_forecast_period(meter):
    start, end = "2024-01-10 00:00:00", "2024-01-22 00:00:00"
    spoiled = meter.withColumn("active_kw", F.when(F.col("datetime_local") < "2024-01-10", F.col("active_kw")).otherwise(F.lit(1e6)))
    for model, options in (("naive", {}), ("median", {})):
        a, b = (fc.forecast(m, start, end, model, decimals=2, **options) for m in (meter, spoiled))
        assert a.exceptAll(b).count() == 0
    # a forecast made day by day knows the readings of a week ago, but none that are newer
    late = meter.withColumn("active_kw", F.when(F.col("datetime_local") < "2024-01-15", F.col("active_kw")).otherwise(F.lit(1e6)))
    a, b, c = (fc.forecast(m, start, end, day_by_day=True, decimals=2) for m in (meter, spoiled, late))
    assert a.exceptAll(c).count() == 0 and a.exceptAll(b).count() == 5 * 96


def test_median_forecast_leaves_the_day_before_out(meter):
    assert fc.day_ahead_history(meter, "2024-01-10 00:00:00").agg(F.max("datetime_local")).first()[0] < dt.datetime(2024, 1, 9)


def test_missing_week_falls_back_to_the_mean(meter):
    cut = meter.where("date(datetime_local) <> '2024-01-09'")
    out = {r.datetime_15min: r.prediction for r in fc.naive_forecast(cut, "2024-01-15 00:00:00", "2024-01-17 00:00:00").collect()}
    past = cut.where("datetime_local < '2024-01-15'").groupBy("datetime_local").agg(F.sum("active_kw").alias("s")).agg(F.avg("s")).first()[0]
    assert out[dt.datetime(2024, 1, 16)] == pytest.approx(past)


def inputs_of(spark, meter):
    hours = meter.select(F.date_trunc("hour", "datetime_local").cast("timestamp_ntz").alias("datetime_local")).distinct()
    feed = hours.select("datetime_local", F.hour("datetime_local").cast("double").alias("value"))
    weather = hours.select(
        "datetime_local", F.lit("a").alias("community_code"), (F.hour("datetime_local") * 1.5).alias("temperature_2m"),
        F.lit(1.0).alias("dew_point_2m"), F.dayofmonth("datetime_local").cast("double").alias("cloud_cover"), F.lit(50.0).alias("relative_humidity_2m"),
    )
    calendar = cal.calendar_features(cal.years_of(meter, "datetime_local"), [cal.HolidayRule("n", 1, 1)], ["a"])
    return weather, region.degree_hours(weather), {f: feed for f in ft.FEEDS}, calendar


def test_boosted_forecast_over_a_grid_without_actuals(spark, meter):
    start, end = "2024-01-22 00:00:00", "2024-01-23 00:00:00"
    demand = ft.demand_series(meter, 2)
    matrix = ft.feature_matrix(demand, *inputs_of(spark, meter), start, end, decimals=2)
    assert matrix.columns == ["datetime_15min", ft.TARGET, *ft.ALL_FEATURES] and len(ft.ALL_FEATURES) == 23
    assert ft.prediction_rows(matrix, start, end).count() == 96
    settings = boosting.BoostingSettings(rounds=4, depth=3)
    out = boosting.boosted_forecast(matrix, start, end, settings)
    again = boosting.boosted_forecast(matrix.repartition(3), start, end, settings)
    assert out.count() == 96 and out.agg(F.min("prediction")).first()[0] >= 0
    assert out.exceptAll(again).count() == 0  # the layout is fixed before sampling
    both = boosting.boosted_forecast(matrix, start, end, settings, seeds=[1, 2])
    assert both.count() == 96
    train = ft.training_rows(matrix, start)
    imp = boosting.importance(boosting.fit_boosting(train, settings=settings)).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1.0) and len(imp) == 23


def test_ensemble_mean(spark):
    runs = spark.createDataFrame([(START, 1.0), (START, 2.0), (START, 6.0)], "datetime_15min timestamp_ntz, prediction double")
    assert boosting.ensemble_mean(runs).first().prediction == 3.0


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = 2.0 + 3.0 * x[:, 0] - 1.0 * x[:, 1] + rng.normal(scale=0.5, size=400)
    rows = [(i, float(a), float(b), float(c), float(a + b), 1.0, float(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, ab double, k double, y double"), x, y


def test_least_squares_against_numpy(regression):
    df, x, y = regression
    got = {r.feature: r for r in linear.fit_ols(df, ["a", "b", "c"], "y").collect()}
    beta = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    assert [got[n].coefficient for n in ("a", "b", "c", "intercept")] == pytest.approx(list(beta))
    pred = linear.predict_ols(linear.fit_ols(df, ["a", "b", "c"], "y"), df, ["a", "b", "c"]).orderBy("id").toPandas()["prediction"]
    assert pred.to_numpy() == pytest.approx(np.column_stack([x, np.ones(len(x))]) @ beta)
    assert got["a"].p_value < 1e-6 and got["c"].p_value > 1e-4 and 0.9 < got["a"].adj_r2 <= got["a"].r2 < 1


def test_dependent_and_constant_columns_are_reported(regression):
    df, _, _ = regression
    assert linear.independent_columns(df, ["a", "b", "c", "ab", "k"]) == (["a", "b", "c"], ["k", "ab"])
    out = linear.ols_selection(df, ["a", "b", "c", "ab", "k"], "y", keys=["id"]).collect()
    by = {r.feature: r for r in out}
    assert by["a"].selected and by["a"].significance == "***" and not by["c"].selected
    assert by["ab"].coefficient is None and by["k"].coefficient is None and not by["ab"].selected
    assert out[0].feature == "a"
    assert linear.ols_selection(df, ["a", "b"], "y", max_rows=100, keys=["id"]).first().n == 100


def days(errors):
    """Two slots a day with the given error and an actual of 100."""
    return [(START + dt.timedelta(days=d, hours=h), 100.0 + e, 100.0) for d, e in enumerate(errors) for h in (0, 12)]


def test_uniform_bias_and_mixed_bias(spark):
    def run(errors):
        p = pairs(spark, days(errors))
        return ev.verdict(ev.daily_error(p), ev.weekly_drift(p)).first()

    under = run([-10.0, -11.0, -9.0, -10.0, -10.0, -11.0, -10.0, -12.0])
    assert under.verdict == "uniform bias" and under.all_under and under.drift == pytest.approx(12.0 - 71.0 / 7)
    assert run([-10.0, 10.0, -10.0]).verdict == "possible overfitting"
    assert run([-1.0, -30.0, -1.0, -30.0]).verdict == "possible overfitting"  # one side, but too wide a spread


def test_summaries(spark):
    p = pairs(spark, [(START, 8.0, 10.0), (START + SLOT, 13.0, 10.0), (START + dt.timedelta(days=1), 20.0, 20.0), (START + dt.timedelta(hours=5), 1.0, 0.0)])
    b = ev.bias_summary(p, 6).first()
    assert (b.actual_mean, b.prediction_mean, b.bias, b.mae, b.bias_pct) == (10.0, 10.5, 0.5, 1.5, 5.0)
    acc = ev.accuracy(p).first()
    assert acc.mae == 1.5 and acc.r2 == pytest.approx(1 - 14 / 200)
    hours = {r.hour: r.error_mean for r in ev.error_by_hour(p, 6).collect()}
    assert hours[5] == 1.0 and hours[0] == pytest.approx(1 / 3, abs=1e-5)
    assert {r.day_of_week for r in ev.error_by_weekday(p).collect()} == {0, 1}
    d = ev.daily_error_summary(ev.daily_error(p)).first()
    assert (d.days, d.positive_days, d.negative_days) == (2, 1, 0)


def test_weeks_count_elapsed_time_from_the_first_match(spark):
    p = pairs(spark, [(START + dt.timedelta(hours=18), 1.0, 1.0), (START + dt.timedelta(days=7, hours=6), 2.0, 1.0), (START + dt.timedelta(days=7, hours=18), 4.0, 1.0)])
    assert {r.week: r.mae for r in ev.weekly_drift(p).collect()} == {0: 0.5, 1: 3.0}


def test_sinks(spark, meter, tmp_path):
    preds = fc.naive_forecast(meter, "2024-01-22 00:00:00", "2024-01-23 00:00:00")
    target = str(tmp_path / "out")
    sinks.overwrite(spark.range(3), target)
    sinks.write_submission(preds, "team", target)
    back = spark.read.parquet(target)
    assert back.columns == ["team_name", "datetime_15min", "prediction", "submitted_at"] and back.count() == 96
    sinks.overwrite(meter.limit(10), str(tmp_path / "m"), ["community_code"])
    assert spark.read.parquet(str(tmp_path / "m")).count() == 10
    names = sinks.register_views({"hour": meter})
    assert names == ["consumption_hour_per_province"] and spark.table(names[0]).count() == meter.count()


def test_schema_check(spark, meter, tmp_path):
    from loadweave.sources import readers

    with pytest.raises(ValueError, match="active_kw"):
        schemas.require(meter.drop("active_kw"), schemas.METER)
    meter.write.parquet(str(tmp_path / "meter.parquet"))
    assert readers.read_meter(spark, str(tmp_path / "meter.parquet")).schema == schemas.METER
    stacked = readers.stack([spark.range(1).withColumn("x", F.lit(1)), spark.range(1).withColumn("y", F.lit(2))])
    assert stacked.columns == ["id", "x", "y"] and stacked.count() == 2
    assert readers.distinct_codes(meter).count() == 2


def test_session_time_zone_does_not_matter(spark):
    """02:30 on 2024-03-10 does not exist in New York; local labels are not shifted by it."""
    first = dt.datetime(2024, 3, 9, 18)
    rows = [(first, 1.0, 1.0), (dt.datetime(2024, 3, 10, 2, 30), 2.0, 1.0), (first + dt.timedelta(days=7), 3.0, 1.0), (first + dt.timedelta(days=7, minutes=-15), 5.0, 1.0)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        p = pairs(spark, rows)
        got = {r.datetime_15min: r.days_from_start for r in ev.elapsed_days(p).collect()}
        assert [got[r[0]] for r in rows] == [0, 0, 7, 6]
        assert {r.hour for r in ev.error_by_hour(p).collect()} == {18, 2, 17}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("model", ["naive", "median"])
def test_every_slot_has_a_value_with_no_partial_or_full_history(meter, model):
    for start in ("2023-12-20 00:00:00", "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-04 00:00:00", "2024-01-15 00:00:00"):
        end = (dt.datetime.fromisoformat(start) + dt.timedelta(days=2)).isoformat(sep=" ")
        out = fc.forecast(meter, start, end, model)
        assert out.count() == 192 and out.where("prediction is null").count() == 0


@pytest.mark.parametrize("options", [{}, {"day_by_day": True}])
def test_both_spellings_of_a_stamp_give_the_same(meter, options):
    sums = []
    for sep in (" ", "T"):
        out = fc.naive_forecast(meter, f"2024-01-15{sep}06:00:00", f"2024-01-25{sep}06:00:00", decimals=2, **options)
        sums.append(out.agg(F.round(F.sum("prediction"), 6)).first()[0])
    assert sums[0] == sums[1]


def test_naive_reads_nothing_from_the_period_and_nothing_too_young(meter):
    start, end = "2024-01-12 00:00:00", "2024-01-22 00:00:00"

    def total(m, **options):
        return fc.naive_forecast(m, start, end, decimals=2, **options).agg(F.round(F.sum("prediction"), 4)).first()[0]

    def louder(since):
        return meter.withColumn("active_kw", F.when(F.col("datetime_local") >= F.lit(since).cast("timestamp_ntz"), F.col("active_kw") * 100).otherwise(F.col("active_kw")))

    assert total(louder(start)) == total(meter)
    assert total(louder("2024-01-10 00:00:00"), availability_lag_days=3) == total(meter, availability_lag_days=3)
    assert total(louder(start), day_by_day=True) != total(meter, day_by_day=True)


def test_boosting_under_the_contract_reads_only_before_the_end(spark):
    from loadweave.catalog import inputs as i, queries as q
    from tests.conftest import SF

    small = boosting.BoostingSettings(rounds=2, depth=2)
    out = fc.forecast(i.meter(spark, SF), "2024-01-24T00:00:00", "2024-01-26T00:00:00", "gbt", **q._exogenous(spark, SF), settings=small, decimals=2)
    assert out.count() == 192 and out.where("prediction is null or prediction < 0").count() == 0
    demand = ft.demand_series(fc.before(i.meter(spark, SF), "2024-01-26T00:00:00"), 2)
    assert "LessThan(ts," in demand._jdf.queryExecution().executedPlan().toString()


def test_p_values_are_those_of_the_t_distribution():
    # quantiles of Student's t from published tables
    for t, freedom, p in ((12.7062, 1, 0.05), (2.2281, 10, 0.05), (2.7500, 30, 0.01), (3.3905, 100, 0.001), (1.9623, 1000, 0.05)):
        assert linear.two_sided(t, freedom) == pytest.approx(p, rel=2e-4)
    assert linear.two_sided(0.0, 5) == 1.0 and linear.two_sided(1e9, 50) < 1e-200


def test_statistics_of_least_squares_against_numpy(regression):
    df, x, y = regression
    got = {r.feature: r for r in linear.fit_ols(df, ["a", "b", "c"], "y").collect()}
    full = np.column_stack([x, np.ones(len(x))])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    left = y - full @ beta
    errors = np.sqrt(left @ left / (len(y) - 4) * np.diag(np.linalg.inv(full.T @ full)))
    assert [got[n].std_error for n in ("a", "b", "c", "intercept")] == pytest.approx(list(errors))
    assert [got[n].t_value for n in ("a", "b", "c", "intercept")] == pytest.approx(list(beta / errors))
    assert got["a"].r2 == pytest.approx(1 - left @ left / ((y - y.mean()) ** 2).sum())


def test_regression_of_few_or_constant_rows(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 4.0, 5.0), (None, 1.0, 1.0)], "a double, b double, y double")
    got = {r.feature: r for r in linear.fit_ols(rows, ["a", "b"], "y").collect()}
    assert set(got) == {"b", "intercept"} and got["b"].coefficient == pytest.approx(1.0) and got["b"].n == 2
    flat = spark.createDataFrame([(float(i), 7.0) for i in range(5)], "a double, y double")
    assert linear.fit_ols(flat, ["a"], "y").where("feature = 'a'").first().coefficient == 0.0
    assert linear.fit_ols(flat.limit(0), ["a"], "y").count() == 1


def test_recursive_forecast_equals_a_plain_loop(spark, meter):
    """Slot by slot in Python, with a dictionary of what is known or predicted."""
    start, end = "2024-01-18 00:00:00", "2024-01-27 12:00:00"
    settings = boosting.BoostingSettings(rounds=6, depth=3)
    inputs = inputs_of(spark, meter)
    got = {r.datetime_15min: r.prediction for r in fc.recursive_forecast(meter, start, end, *inputs, settings=settings).collect()}
    assert len(got) == 9 * 96 + 48

    matrix = ft.feature_matrix(ft.demand_series(fc.before(meter, start)), *inputs, start, end)
    train = ft.training_rows(matrix, start)
    forest = trees.Forest(boosting.fit_boosting(train, settings=settings).nodes.collect())
    medians = {c: float(np.median([r[c] for r in train.select(c).collect()])) for c in ft.ALL_FEATURES}
    demand = {r.datetime_15min: r.demand_kw for r in ft.demand_series(fc.before(meter, start)).collect()}
    rows = {r.datetime_15min: r.asDict() for r in ft.prediction_rows(matrix, start, end).collect()}
    day = dt.timedelta(days=1)

    def rolling(at):
        if at not in demand:
            return None
        last = [demand[k] for k in sorted(k for k in demand if k <= at)[-672:]]
        return sum(last) / len(last) if len(last) >= 96 else None

    for at in sorted(rows):
        x = rows[at] | {"demand_lag_7d": demand.get(at - 7 * day), "demand_lag_1d": demand.get(at - day), "rolling_mean_7d": rolling(at - day)}
        values = [medians[c] if x[c] is None else float(x[c]) for c in ft.ALL_FEATURES]
        demand[at] = max(0.0, float(forest.predict(np.array([values]))[0, 0]))
        assert got[at] == pytest.approx(demand[at], rel=1e-9)
