from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loadweave.functions import numeric as n, timeparts as t


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_clip_keeps_null(spark):
    null = F.lit(None).cast("double")
    r = one(spark, a=n.clip(null, low=0.0), b=n.clip(F.lit(-2.0), low=0.0), c=n.clip(F.lit(40.0), 0.0, 30.0))
    assert (r.a, r.b, r.c) == (None, 0.0, 30.0)


def test_division_by_zero_and_bad_text_give_null(spark):
    r = one(
        spark,
        a=n.ratio(F.lit(1.0), F.lit(0.0)),
        b=n.percent(F.lit(1.0), F.lit(4.0)),
        c=n.to_number(F.lit("x")),
        d=n.comma_number(F.lit(" 12,0 ")),
        e=n.comma_number(F.lit("Ip")),
        f=n.comma_number(F.lit("3,4")),
    )
    assert tuple(r) == (None, 25.0, None, 12.0, None, 3.4)


def test_log_scale_round_trip(spark):
    r = one(spark, a=n.unlog_scale(n.log_scale(F.lit(123.5))), b=n.log_scale(F.lit(-5.0)), c=n.unlog_scale(F.lit(99.0)))
    assert r.a == pytest.approx(123.5) and r.b == 0.0 and r.c == pytest.approx(1.0686474581524463e13)


def test_exact_sum_does_not_depend_on_order(spark):
    df = spark.range(20000).select((F.col("id") % 977 * 0.01).alias("v"))
    sums = {df.repartition(p).agg(n.total("v", 2).alias("s")).first().s for p in (1, 3, 7)}
    assert len(sums) == 1
    assert df.agg(n.mean("v", 2)).first()[0] == pytest.approx(df.agg(F.avg("v")).first()[0])


def test_weekday_codings(spark):
    # 2024-01-01 is a Monday
    df = spark.range(7).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    rows = df.select(t.dow_mon0("d"), t.dow_sun1("d"), t.mon0_to_sun1(t.dow_mon0("d")), t.day_name("d"), t.is_weekend("d")).collect()
    assert [r[0] for r in rows] == list(range(7))
    assert [r[1] for r in rows] == [2, 3, 4, 5, 6, 7, 1] == [r[2] for r in rows]
    assert tuple(r[3] for r in rows) == t.DAY_NAMES
    assert [r[4] for r in rows] == [0, 0, 0, 0, 0, 1, 1]


def test_truncation_stays_zone_free(series):
    df = series([("2024-02-29T23:59:59", 1.0)])
    out = df.select(
        t.slot_start("datetime_15min").alias("s"), t.week_start("datetime_15min").alias("w"),
        t.month_start("datetime_15min").alias("m"), t.interval_idx("datetime_15min").alias("i"),
    )
    assert {d for _, d in out.dtypes} == {"timestamp_ntz", "int"}
    assert tuple(out.first()) == (dt.datetime(2024, 2, 29, 23, 45), dt.datetime(2024, 2, 26), dt.datetime(2024, 2, 1), 95)


def test_lenient_parsing(spark):
    r = one(spark, a=t.parse_day(F.lit("2024-13-01")), b=t.parse_day(F.lit(" 2024-03-01 ")), c=t.parse_stamp(F.lit("2024-03-01T05:00")), d=t.parse_stamp(F.lit("?")))
    assert tuple(r) == (None, dt.date(2024, 3, 1), dt.datetime(2024, 3, 1, 5), None)
