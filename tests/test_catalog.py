"""Every registered query against its SQL twin, and the shape of the plans."""

from __future__ import annotations

import datetime as dt
import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loadweave.catalog import queries
from loadweave.catalog.oracle import ORACLE
from loadweave.catalog.queries import QUERIES
from loadweave.plans import boosting
from tests.conftest import SF

ROWS_ONLY = {"gbt_forecast", "ensemble_forecast", "gbt_importance", "gbt_recursive", "ols_selection", "next_day_ols", "next_day_ols_scores", "next_day_boosting", "lag_boosting"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def test_only_models_lack_a_twin():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, result.fetchall())


@pytest.mark.parametrize("name,rows", [("ols_selection", 17), ("next_day_ols", 5), ("next_day_ols_scores", 2)])
def test_model_queries_run(spark, name, rows):
    assert QUERIES[name](spark, SF).count() == rows


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


# the readings are scanned once, however many branches use them
@pytest.mark.parametrize(
    "name",
    ["total_15min", "multigrain_features", "clock_lags", "row_lags", "rolling_safe", "lagged_demand", "next_day_target",
     "upsample_carry", "median_baseline", "median_forecast", "naive_forecast", "naive_week_ago", "client_daily_profile", "label_ids"],
)
def test_one_scan_of_the_readings(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    finals = re.sub(r"== Initial Plan ==.*?(?=== Final Plan ==|\Z)", "", plan, flags=re.S)
    # a scan inside a reused subquery is printed in the subquery's own plan
    assert finals.count("FileScan parquet") <= 1


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_no_cross_join_and_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan


def test_period_and_columns_reach_the_scan(spark):
    plan = executed(QUERIES["naive_forecast"](spark, SF))
    pushed = QUERIES["median_forecast"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(ts,", pushed)
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in pushed
    assert "Subquery" in plan


def test_ensemble_runs_full_models(monkeypatch):
    called = {}
    monkeypatch.setattr(queries, "_exogenous", lambda s, d: {})
    monkeypatch.setattr(queries.i, "meter", lambda s, d: None)
    monkeypatch.setattr(queries.fc, "forecast", lambda *a, **named: called.update(named))
    QUERIES["ensemble_forecast"](None, SF)
    assert called["settings"] == boosting.SCORED and called["settings"].rounds == 1000 and called["seeds"] == [42, 43, 44]


def test_ols_takes_all_slots(spark):
    rows = queries._candidates(spark, SF, carried=True).dropna()
    by_minute = {r["m"]: r["count"] for r in rows.groupBy(F.minute("datetime_15min").alias("m")).count().collect()}
    full_hours = queries._candidates(spark, SF).dropna().count()
    assert set(by_minute) == {0, 15, 30, 45} and by_minute[0] >= full_hours
    fitted = [r["n"] for r in QUERIES["ols_selection"](spark, SF).collect() if r["n"] is not None]
    assert set(fitted) == {sum(by_minute.values())} and fitted[0] > 3 * full_hours


def test_bucketed_grains_join_without_a_shuffle(spark):
    # as of tables too large for a broadcast
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(QUERIES["grains_written"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan


def test_partitions_of_other_regions_and_months_are_not_read(spark):
    df = QUERIES["temporal_partitions"](spark, SF)
    assert df.count() > 0
    plan = executed(df)
    assert "dynamicpruning" in plan and re.search(r"PartitionFilters: \[isnotnull\(month", plan)


def test_measures_come_out_of_the_write(spark):
    """One job writes and measures: the readings are scanned once."""
    tracker = spark.sparkContext.statusTracker()
    weather = queries.i.weather(spark, SF)
    spark.sparkContext.setJobGroup("measured", "measured")
    out = queries.sinks.overwrite_measured(weather, queries._own_folder(spark) + "/w", "datetime_local").collect()
    spark.sparkContext.setJobGroup("none", "none")
    stages = {s for j in tracker.getJobIdsForGroup("measured") for s in tracker.getJobInfo(j).stageIds}
    assert len(stages) <= 4 and {r["row_count"] for r in out} == {weather.count()}


def test_a_second_write_replaces_its_own_partitions_only(spark, tmp_path):
    sinks, path = queries.sinks, str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "v int, k string, m int")
    sinks.overwrite_partitions(rows, path, ["k", "m"])
    sinks.overwrite_partitions(spark.createDataFrame([(9, "a", 2), (8, "c", 1)], "v int, k string, m int"), path, ["k", "m"])
    sinks.overwrite_partitions(rows.limit(0), path, ["k", "m"])
    assert sorted(tuple(r) for r in spark.read.schema(rows.schema).parquet(path).collect()) == [(1, "a", 1), (3, "b", 1), (8, "c", 1), (9, "a", 2)]
