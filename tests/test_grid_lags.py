from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.operators import feeds, grid, lags

START = dt.datetime(2024, 1, 1)
SLOT = dt.timedelta(minutes=15)


@pytest.fixture(scope="module")
def gappy(spark):
    """Twelve days of slots with random gaps, a missing hour and a missing day."""
    rnd = random.Random(7)
    rows = []
    for i in range(12 * 96):
        ts = START + i * SLOT
        missing_hour = ts.date() == dt.date(2024, 1, 4) and ts.hour == 2
        if rnd.random() < 0.1 or missing_hour or ts.date() == dt.date(2024, 1, 6):
            continue
        rows.append((ts, float(rnd.randrange(1000)) / 100))
    return rows


@pytest.fixture(scope="module")
def frame(spark, gappy):
    return spark.createDataFrame(gappy, "datetime_15min timestamp_ntz, kw double").repartition(5)


def test_slot_grid(spark):
    g = grid.slot_grid(spark, "2024-01-01 00:00:00", "2024-01-03 00:00:00")
    assert g.count() == 192 and g.agg(F.max("datetime_15min")).first()[0] == dt.datetime(2024, 1, 2, 23, 45)
    assert grid.slot_grid(spark, "2024-01-01", "2024-01-01").count() == 0


def test_keyed_grid_cuts_to_the_period(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    g = grid.keyed_slot_grid(keys, "2024-01-01 12:00:00", "2024-01-02 06:00:00")
    assert g.groupBy("k").count().collect()[0]["count"] == 72 and g.count() == 144
    assert grid.keyed_slot_grid(keys, "2024-01-01", "2024-01-01").count() == 0


def test_day_spine(spark):
    assert grid.day_spine(spark, "2024-02-28", "2024-03-01").count() == 3


def test_carry_repeats_null_rows_and_stops_at_the_last_stamp(series):
    src = series([("2024-01-01T22:00:00", 1.0), ("2024-01-01T23:00:00", None), ("2024-01-02T02:00:00", 3.0)])
    got = {r[0]: r[1] for r in grid.carry(src, "datetime_15min", ["v"]).collect()}
    assert len(got) == 17 and max(got) == dt.datetime(2024, 1, 2, 2)
    assert got[dt.datetime(2024, 1, 1, 22, 45)] == 1.0
    assert got[dt.datetime(2024, 1, 2, 1, 45)] is None
    assert got[dt.datetime(2024, 1, 2, 2)] == 3.0
    passed = {r[0]: r[1] for r in grid.carry(src, "datetime_15min", ["v"], carry_nulls=False).collect()}
    assert len(passed) == 17 and passed[dt.datetime(2024, 1, 2, 1, 45)] == 1.0


def test_carry_over_days_without_rows_and_off_grid_stamps(series):
    src = series([("2024-01-01T10:07:00", 1.0), ("2024-01-04T00:00:00", 2.0), ("2024-01-04T00:20:00", 3.0)])
    got = {r[0]: r[1] for r in grid.carry(src, "datetime_15min", ["v"]).collect()}
    slots = pd.date_range("2024-01-01 10:15", "2024-01-04 00:15", freq="15min")
    assert sorted(got) == list(slots.to_pydatetime())
    assert got[dt.datetime(2024, 1, 3, 23, 45)] == 1.0 and got[dt.datetime(2024, 1, 4, 0, 15)] == 2.0


def test_dedupe_prefers_values_over_nulls(series):
    src = series([("2024-01-01T00:00:00", None), ("2024-01-01T00:00:00", 5.0), ("2024-01-01T00:00:00", 4.0)])
    assert [tuple(r) for r in grid.dedupe(src, "datetime_15min", ["v"]).collect()] == [(START, 4.0)]


def test_feed_merge_equals_outer_joins(spark, series):
    a = series([("2024-01-01T00:00:00", 1.0), ("2024-01-01T01:00:00", 2.0)], "datetime_local timestamp_ntz, value double")
    b = series([("2024-01-01T01:00:00", 3.0), ("2024-01-01T02:00:00", None)], "datetime_local timestamp_ntz, value double")
    c = series([("2024-01-01T03:00:00", 9.0)], "datetime_local timestamp_ntz, value double")
    got = feeds.merge_feeds({"x": a, "y": b, "z": c})
    joined = (
        a.withColumnRenamed("value", "x")
        .join(b.withColumnRenamed("value", "y"), "datetime_local", "outer")
        .join(c.withColumnRenamed("value", "z"), "datetime_local", "outer")
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, joined.collect()))


def test_duplicate_feed_stamps_do_not_multiply_rows(series):
    axis = series([("2024-01-01T00:00:00", 1.0)])
    feed = series([("2024-01-01T00:00:00", 7.0)] * 3, "datetime_local timestamp_ntz, value double")
    out = feeds.join_feeds(axis, {"f": feed})
    assert [r.f for r in out.collect()] == [7.0]


def test_clock_lag_against_brute_force(frame, gappy):
    known = dict(gappy)
    out = lags.clock_lags(frame, {"d1": 1, "d7": 7}, value="kw").collect()
    assert len(out) == len(gappy)
    for r in out:
        ts = r.datetime_15min
        assert r.d1 == known.get(ts - dt.timedelta(days=1)) and r.d7 == known.get(ts - dt.timedelta(days=7))


def test_row_lag_differs_from_clock_lag_where_slots_are_missing(frame, gappy):
    values = [v for _, v in gappy]
    out = {r.datetime_15min: r for r in lags.row_lags(frame, {"b": 96, "f": -96}, value="kw").collect()}
    for i, (ts, _) in enumerate(gappy):
        assert out[ts].b == (values[i - 96] if i >= 96 else None)
        assert out[ts].f == (values[i + 96] if i + 96 < len(values) else None)
    clock = {r.datetime_15min: r.b for r in lags.clock_lags(frame, {"b": 1}, value="kw").collect()}
    assert any(clock[ts] != out[ts].b for ts, _ in gappy)


def test_row_index_per_key(spark):
    rows = [(k, START + i * dt.timedelta(hours=7), 1.0) for k in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").repartition(6)
    got = {(r.k, r.ts): r.rn for r in lags.row_index(df, "ts", "v", ["k"]).collect()}
    assert all(got[(k, START + i * dt.timedelta(hours=7))] == i + 1 for k in "ab" for i in range(40))


def test_rolling_frames_against_pandas(frame, gappy):
    s = pd.Series([v for _, v in gappy], index=[ts for ts, _ in gappy])
    got = lags.rolling_previous_week(frame, value="kw", decimals=2).toPandas().set_index("datetime_15min").sort_index()
    before = s.shift(1).rolling(672, min_periods=1)
    assert got["rolling_mean_7d"].iloc[1:].to_numpy() == pytest.approx(before.mean().iloc[1:].to_numpy())
    assert got["rolling_std_7d"].iloc[2:].to_numpy() == pytest.approx(before.std().iloc[2:].to_numpy())
    safe = lags.rolling_week_inclusive(frame, value="kw").toPandas().set_index("datetime_15min").sort_index()
    expected = s.rolling(672, min_periods=96).mean()
    assert safe["rolling_mean_7d"].isna().sum() == expected.isna().sum() == 95
    assert safe["rolling_mean_7d"].dropna().to_numpy() == pytest.approx(expected.dropna().to_numpy())


def test_day_ahead_features_ignore_readings_of_the_last_day(spark, gappy):
    """A feature at t may not change when readings later than t - 1 day change."""
    t0 = START + dt.timedelta(days=10, hours=5)
    changed = [(ts, v if ts <= t0 - dt.timedelta(days=1) else v + 50.0) for ts, v in gappy]

    def at(rows, build):
        df = spark.createDataFrame(rows, "datetime_15min timestamp_ntz, demand_kw double")
        return build(df).where(F.col("datetime_15min") <= t0).drop("demand_kw").orderBy("datetime_15min").collect()

    def last(rows, build):
        return at(rows, build)[-1]

    def safe(df):
        return lags.lagged_demand(df)

    assert last(gappy, safe) == last(changed, safe)

    def by_row(df):
        return lags.rolling_previous_week(df, value="demand_kw")

    assert last(gappy, by_row) != last(changed, by_row)


def test_longer_availability_lag_keeps_the_previous_day_out(spark, gappy):
    df = spark.createDataFrame(gappy, "datetime_15min timestamp_ntz, demand_kw double")
    known = dict(gappy)
    for r in lags.lagged_demand(df, availability_lag_days=2).collect():
        assert r.demand_lag_1d == known.get(r.datetime_15min - dt.timedelta(days=2))


def test_weekly_source_slot(spark):
    g = grid.slot_grid(spark, "2024-01-10 00:00:00", "2024-01-26 00:00:00")
    rows = g.select("datetime_15min", lags.source_slot("datetime_15min", "2024-01-10 00:00:00").alias("s")).collect()
    for r in rows:
        h = (r.datetime_15min.date() - dt.date(2024, 1, 10)).days + 1
        assert r.s == r.datetime_15min - dt.timedelta(days=7 * -(-h // 7)) and r.s < dt.datetime(2024, 1, 10)


def test_next_day_target_per_community(spark):
    rows = [(c, START + i * SLOT, float(i)) for c in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "community_code string, datetime_15min timestamp_ntz, total_active_kw double")
    out = lags.next_day_target(df).collect()
    assert len(out) == 2 * 104 and all(r.target == r.total_active_kw + 96 for r in out)


def test_feeds_are_carried_each_over_its_own_stamps(series):
    a = series([("2024-01-01T00:00:00", 1.0), ("2024-01-01T01:00:00", 2.0)], "datetime_local timestamp_ntz, value double")
    b = series([("2024-01-01T00:30:00", 5.0), ("2024-01-03T00:30:00", 6.0)], "datetime_local timestamp_ntz, value double")
    got = {r.datetime_15min: (r.a, r.b) for r in feeds.feeds_slots({"a": a, "b": b}).collect()}
    assert got[START] == (1.0, None) and got[START + dt.timedelta(hours=1)] == (2.0, 5.0)
    assert got[START + dt.timedelta(hours=1, minutes=15)] == (None, 5.0)
    assert max(got) == dt.datetime(2024, 1, 3, 0, 30) and got[dt.datetime(2024, 1, 3, 0, 15)] == (None, 5.0)
    single = {r[0]: r[1] for r in feeds.feed_slots(b, "b").collect()}
    assert single == {ts: v[1] for ts, v in got.items() if v[1] is not None}


def test_a_repeated_stamp_keeps_one_of_its_rows(spark, series):
    df = series([("2024-01-01T00:00:00", 5.0, 2), ("2024-01-01T00:00:00", 1.0, 9), ("2024-01-02T00:00:00", 3.0, 4)], "datetime_15min timestamp_ntz, v double, w int")
    got = sorted(tuple(r)[1:] for r in lags.clock_lags(df, {"lag": 1}, value="v").collect())
    assert got == [(3.0, 4, 5.0), (5.0, 2, None)]


def test_the_weekly_lag_is_a_multiple_of_seven_days(spark, series):
    rows = [((dt.datetime(2024, 1, 1) + dt.timedelta(days=d)).isoformat(), float(d)) for d in range(30)]
    out = lags.lagged_demand(series(rows, "datetime_15min timestamp_ntz, demand_kw double"), availability_lag_days=10)
    assert all(r["demand_kw"] - r["demand_lag_7d"] == 14 for r in out.where("demand_lag_7d is not null").collect())
    assert all(r["demand_kw"] - r["demand_lag_1d"] == 10 for r in out.where("demand_lag_1d is not null").collect())


def test_feed_join_runs_no_job(spark, series):
    axis = series([("2024-01-01T00:00:00", 1.0)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        feeds.join_feeds(axis, {"a": axis.withColumnsRenamed({"datetime_15min": "datetime_local", "v": "value"})})
        assert not tracker.getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
