from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loadweave.catalog import inputs
from loadweave.functions import timeparts as t
from loadweave.operators import encode, profile as p, rollup as ru
from tests.conftest import SF

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def meter(spark):
    return inputs.meter(spark, SF).cache()


def test_every_grain_adds_up_to_the_readings(meter):
    raw = meter.agg(F.sum(F.rint(F.col("active_kw") * 100).cast("long"))).first()[0]
    for grain in ru.GRAIN_COLUMN:
        total = ru.rollup(meter, grain, ["community_code"], decimals=2).agg(F.sum("total_active_kw")).first()[0]
        assert round(total * 100) == raw


def test_coarser_grains_from_slots_equal_those_from_readings(meter):
    frames = ru.all_grains(ru.rollup(meter, "15min", ["community_code"], decimals=2), ["community_code"], 2)
    for grain, df in frames.items():
        direct = ru.rollup(meter, grain, ["community_code"], decimals=2)
        assert df.exceptAll(direct.select(*df.columns)).count() == 0


def test_multigrain_equals_join_form(meter):
    got = ru.multigrain(meter, decimals=2)
    base = ru.rollup(meter, "15min", ["community_code"], decimals=2)
    base = base.withColumns({"date": F.to_date("datetime_15min"), "week_start": t.week_start("datetime_15min"), "month_start": t.month_start("datetime_15min")})
    base = base.withColumn("datetime_hour", t.slot_start("datetime_15min", 60))
    for grain in ("day", "hour", "week", "month"):
        side = ru.rollup(meter, grain, ["community_code"], out=f"{grain}_total_active_kw", decimals=2)
        base = base.join(side, ["community_code", ru.GRAIN_COLUMN[grain]], "left")
    cols = ["community_code", "datetime_15min", "total_active_kw", *[f"{g}_total_active_kw" for g in ("day", "hour", "week", "month")]]
    assert got.select(cols).exceptAll(base.select(cols)).count() == 0 and got.count() == base.count()


def test_labels_are_dense_and_ordered(spark):
    ids = [5, 70, 71, 1000, 999_999, -3]
    df = spark.createDataFrame([(i,) for i in ids * 3], "id bigint")
    got = {r.id: r.label for r in encode.label_ids(df, "id", "label").collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}
    codes = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    assert {r.c: r.label for r in encode.label_codes(codes, "c", "label").collect()} == {"a": 0, "b": 1}
    assert encode.cardinality(encode.label_ids(df, "id", "l"), "l").first().n == 6


def test_pivot_and_back_is_identity(meter):
    days = p.daily_arrays(ru.rollup(meter, "15min", decimals=2))
    long = p.profile_rows(days, value="total_active_kw").where("total_active_kw is not null")
    slots = ru.rollup(meter, "15min", decimals=2)
    assert long.select("datetime_15min", "total_active_kw").exceptAll(slots).count() == 0 and long.count() == slots.count()
    wide = p.wide_profiles(meter, decimals=2)
    assert wide.columns == ["date", *map(str, range(96))]
    assert wide.exceptAll(p.to_wide(days)).count() == 0


def slots(spark, rows):
    return spark.createDataFrame(rows, "community_code string, datetime_15min timestamp_ntz, total_active_kw double")


def test_full_day_and_gap_day_arrays(spark):
    full = [("a", START + i * dt.timedelta(minutes=15), float(i)) for i in range(96)]
    random.Random(1).shuffle(full)
    gap = [("a", START + dt.timedelta(days=1, minutes=30), 7.0)]
    rows = {r.date: r.profile for r in p.daily_arrays(slots(spark, full + gap), ["community_code"], fill=0.0).collect()}
    assert rows[dt.date(2024, 1, 1)] == [float(i) for i in range(96)]
    assert rows[dt.date(2024, 1, 2)] == [0.0, 0.0, 7.0] + [0.0] * 93


def mondays(spark, values, slot=0):
    return slots(spark, [("a", START + dt.timedelta(days=7 * i, minutes=15 * slot), v) for i, v in enumerate(values)])


def test_median_takes_an_observed_value_unless_exact(spark):
    df = mondays(spark, [1.0, 2.0, 10.0, 20.0])

    def hist(**kw):
        return p.median_baseline(df, **kw).where("interval_idx = 0").first().hist

    assert hist() == 2.0 and hist(exact=True) == 6.0
    assert hist(recent_from="2024-01-15") == 10.0


def test_gaps_count_as_zero_load_unless_told_otherwise(spark):
    df = mondays(spark, [4.0, 6.0]).unionByName(slots(spark, [("a", START + dt.timedelta(days=14, hours=3), 1.0)]))
    assert p.median_baseline(df, exact=True).where("interval_idx = 0").first().hist == 4.0
    assert p.median_baseline(df, exact=True, gaps_as_zero=False).where("interval_idx = 0").first().hist == 5.0


def test_missing_weekday_takes_the_mean_of_the_others(spark):
    df = slots(spark, [("a", START, 10.0), ("a", START + dt.timedelta(days=1), 20.0), ("b", START, 1.0)])
    out = {r.datetime_15min: r.prediction for r in p.baseline_forecast(p.median_baseline(df), "2024-01-08 00:00:00", "2024-01-11 00:00:00").collect()}
    assert len(out) == 3 * 96
    assert out[dt.datetime(2024, 1, 8)] == 11.0  # Monday: both known
    assert out[dt.datetime(2024, 1, 9)] == 21.0  # Tuesday: b falls back to its Monday
    assert out[dt.datetime(2024, 1, 10)] == 16.0  # Wednesday: mean(10, 20) + 1


def test_weekday_lag_fallbacks(spark):
    rows = [("a", START + dt.timedelta(days=i), float(i)) for i in range(20) if i != 9]
    days = p.daily_arrays(slots(spark, rows), fill=0.0)
    got = sorted(p.weekday_lag_profiles(days).collect(), key=lambda r: r.date)
    own = [r.profile[0] for r in got]
    for i, r in enumerate(got):
        assert r.lag7[0] == (own[i - 7] if i >= 7 else own[i])
        assert r.lag14[0] == (own[i - 14] if i >= 14 else own[max(i - 7, 0)])


def test_feed_profile_fills_gaps_and_names_columns(spark):
    df = spark.createDataFrame([(START, 1.0, None, 3.0), (START, 0.5, None, 3.0)], "datetime_local timestamp_ntz, demand_fc double, pv_fc double, wind_fc double")
    row = p.feed_profile(df).first()
    assert len(row) == 289 and row["0_d"] == 0.5 and row["0_p"] == 0.0 and row["95_w"] == 0.0
    assert list(row.asDict())[1:4] == ["0_d", "0_p", "0_w"]


def test_conditioned_profiles_keep_whole_days_only(spark):
    rows = [(START + i * dt.timedelta(minutes=15), float(i), 1.0, 2.0, None) for i in range(100)]
    df = spark.createDataFrame(rows, "datetime_15min timestamp_ntz, total_active_kw double, demand_fc double, pv_fc double, wind_fc double")
    whole = p.conditioned_profiles(df).collect()
    assert [r.date for r in whole] == [dt.date(2024, 1, 1)] and whole[0].profile[95] == 95.0
    both = p.conditioned_profiles(df, full=False).collect()
    assert len(both) == 2 and all(r.wind_fc_mean == 0.0 for r in both)


def test_a_client_with_a_third_of_all_readings(spark):
    """The hot key costs one partial row per task and slot, and the totals stay whole."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("client_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 2880).cast("int") * 15, F.lit(0))).alias("datetime_local"),
        F.lit("a").alias("community_code"),
        F.lit(1.0).alias("active_kw"),
    )
    out = ru.rollup(df, "15min", ["client_id"])
    assert out.agg(F.sum("total_active_kw")).first()[0] == 30000.0
    assert out.where("client_id = -1").agg(F.sum("total_active_kw")).first()[0] == 10000.0
