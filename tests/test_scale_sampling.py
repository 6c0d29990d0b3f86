from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from loadweave.catalog import queries
from loadweave.operators import encode, profile, quality, sampling, scale


@pytest.fixture(scope="module")
def long(spark):
    rows = [("a", 0, float(v)) for v in (1, 2, 3, 10)] + [("b", 0, 5.0), ("c", 0, 7.0)]
    return spark.createDataFrame(rows, "entity string, interval_idx int, kw double")


@pytest.mark.parametrize("log", [False, True])
def test_group_scaling_round_trip(long, log):
    keys = ["entity", "interval_idx"]
    stats = scale.fit_groups(long.where("entity <> 'c'"), keys, "kw", log)
    scaled = scale.scale_groups(long, stats, keys, "kw", log=log)
    a = scaled.where("entity = 'a'").agg(F.avg("scaled"), F.stddev_pop("scaled")).first()
    assert a[0] == pytest.approx(0.0, abs=1e-12) and a[1] == pytest.approx(1.0)
    assert scaled.where("entity = 'b'").first().scaled == 0.0  # one row: zero spread, divisor 1
    assert scaled.where("entity = 'c'").first().scaled == 0.0  # never trained on
    back = scale.unscale_groups(scaled.where("entity <> 'c'"), stats, keys, log=log).collect()
    assert all(r.restored == pytest.approx(r.kw) for r in back)


def test_column_scaling_uses_training_rows_only(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (100.0, 4.0)], "x double, k double")
    out = scale.scale_columns(df, df.where("x < 50"), ["x", "k"]).orderBy("x").collect()
    assert [r.x_scaled for r in out] == [-1.0, 1.0, 98.0] and [r.k_scaled for r in out] == [0.0] * 3


def test_median_imputation(spark):
    train = spark.createDataFrame([(1.0, None), (2.0, None), (9.0, None), (10.0, None)], "x double, y double")
    rows = spark.createDataFrame([(None, None), (3.0, 4.0)], "x double, y double")
    assert [tuple(r) for r in quality.impute_medians(rows, train, ["x", "y"]).collect()] == [(5.5, 0.0), (3.0, 4.0)]


def test_entity_sample_is_whole_and_independent_of_layout(spark):
    df = spark.range(20000).select((F.col("id") % 1000).alias("client_id"), "id")
    for portable in (False, True):
        a = sampling.sample_entities(df, "client_id", 0.3, portable=portable)
        b = sampling.sample_entities(df.repartition(13), "client_id", 0.3, portable=portable)
        assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
        kept = a.groupBy("client_id").count().collect()
        assert {r["count"] for r in kept} == {20} and 230 < len(kept) < 370


def test_row_cap_is_exact_and_uniform(spark):
    df = spark.range(30000).withColumn("half", F.col("id") < 15000)
    out = sampling.sample_at_most(df, 2000, ["id"])
    assert out.count() == 2000 == out.select("id").distinct().count()
    assert 800 < out.where("half").count() < 1200
    exact = df.orderBy(sampling.hash_fraction(["id"]), "id").limit(2000)
    assert out.exceptAll(exact).count() == 0
    assert sampling.sample_at_most(df, 50000, ["id"]).count() == 30000


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(5000)
    train, test = sampling.random_split(df, ["id"], 0.8)
    assert train.unionByName(test).exceptAll(df).count() == 0 and train.count() + test.count() == 5000
    assert 3800 < train.count() < 4200


def test_one_hot_has_fixed_columns(spark):
    df = spark.createDataFrame([(1, 12), (None, 1)], "day_of_week int, month int").withColumns(encode.calendar_one_hot())
    first, second = df.collect()
    assert len(df.columns) == 21 and first.dow_1 == 1 and first.month_12 == 1 and second.dow_1 == 0 and second.month_1 == 1


def test_table_profile_and_describe(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 2.0), ("b", 2, None)], "k string, t int, v double")
    rows = {r.k: r for r in quality.table_profile(df, "t", "k", {"avg_v": "v"}, {"sum_v": "v"}).collect()}
    assert (rows["a"].row_count, rows["a"].min_time, rows["a"].max_time, rows["a"].avg_v, rows["a"].sum_v) == (2, 1, 3, 1.5, 3.0)
    assert rows["b"].avg_v is None
    d = quality.describe(df, ["v", "t"]).where("column_name = 'v'").first()
    assert (d.n, d["mean"], d["min"], d.p50, d["max"]) == (2, 1.5, 1.0, 1.5, 2.0)


def test_quantiles_of_a_skewed_column(spark):
    """A third of the rows share one value; the rest are spread over many ranges."""
    df = spark.range(9001).select(F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.col("id") * 0.5 - 100).alias("v"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    exact = df.agg(F.percentile("v", probs)).first()[0]
    assert list(quality.quantiles(df.repartition(7), ["v"], probs).drop("column_name").first()) == pytest.approx(exact)
    sketch = quality.describe(df, ["v"], accuracy=100_000).first()
    assert sketch.p50 == pytest.approx(exact[3], abs=1.0)
    assert quality.describe(df.where("v is null"), ["v"]).first().p50 is None


@pytest.mark.parametrize("log", [False, True])
def test_days_scaled_as_arrays_equal_their_rows(spark, log):
    """Zeros, nulls, missing training, a null key and slots that are always zero."""
    rows = [("a", 1, [0.0, 1.25, None]), ("a", 2, [0.0, 3.5, 2.0]), ("a", 3, [7.0, -1.0, None]), ("b", 1, [5.0, 0.0, None]), ("b", 9, [1.0, 1.0, 1.0]), ("c", 9, [2.0, 0.0, None]), (None, 1, [1.0, 2.0, 3.0])]
    days = spark.createDataFrame(rows, "entity string, date int, profile array<double>")
    keys, long = ["entity", "interval_idx"], profile.to_long(days)
    want = scale.scale_groups(long, scale.fit_groups(long.where("date < 9"), keys, "kw", log, 2), keys, "kw", log=log)
    stats = scale.fit_groups(days.where("date < 9"), keys, "kw", log, 2, "profile")
    out = scale.scale_groups(days, stats, keys, "kw", log=log, profile="profile")
    assert out.columns == want.columns and out.count() == 21
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_client_scaled_profiles_shuffles_filled_slots_only(spark):
    out = queries.client_scaled_profiles(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().explainString(out.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) Exchange.*\nInput \[\d+\]: (.*)", plan)
    assert moved and not [m for m in moved if "interval_idx" in m or "profile" in m]
