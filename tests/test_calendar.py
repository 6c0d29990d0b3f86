from __future__ import annotations

import datetime as dt

import pytest

from loadweave.operators import calendar as cal
from loadweave.operators.calendar import HolidayRule
from loadweave.sources.dimensions import CALENDAR_REGIONS, SPAIN_RULES


def years(spark, *values):
    return spark.createDataFrame([(y,) for y in values], "year int")


def build(spark, rules, regions=("A", "B"), ys=(2024,), **kw):
    return {r.date: r for r in cal.calendar_features(years(spark, *ys), rules, regions, **kw).collect()}


def test_easter(spark):
    got = years(spark, 1995, 2000, 2019, 2024, 2025, 2026, 2038).selectExpr("year", f"{cal.easter_sunday()} as e").collect()
    assert {r.year: (r.e.month, r.e.day) for r in got} == {
        1995: (4, 16), 2000: (4, 23), 2019: (4, 21), 2024: (3, 31), 2025: (4, 20), 2026: (4, 5), 2038: (4, 25),
    }


def test_bridges_need_the_neighbour_in_the_same_year(spark):
    # 2024-12-31 is a Tuesday, 2025-01-01 a Wednesday; 2019-01-01 a Tuesday, 2018-12-31 a Monday
    rules = [HolidayRule("n", 1, 1), HolidayRule("r", 12, 31, region="A")]
    c = build(spark, rules, ys=(2018, 2019, 2024))
    assert c[dt.date(2024, 12, 30)].bridge_A == 1 and c[dt.date(2024, 12, 30)].bridge_B == 0
    assert c[dt.date(2018, 12, 31)].bridge_B == 0
    # 2015-01-01 is a Thursday, the Friday after it bridges for everyone
    c = build(spark, rules, ys=(2015,))
    assert c[dt.date(2015, 1, 2)].bridge_A == c[dt.date(2015, 1, 2)].bridge_B == 1


def test_regional_flags_include_national_days_and_count_regions(spark):
    c = build(spark, [HolidayRule("n", 5, 1), HolidayRule("r", 5, 2, region="B")])
    nat, reg = c[dt.date(2024, 5, 1)], c[dt.date(2024, 5, 2)]
    assert (nat.holiday_A, nat.holiday_B, nat.num_regions_holiday, nat.national_holiday_name) == (1, 1, 2, "n")
    assert (reg.holiday_A, reg.holiday_B, reg.num_regions_holiday, reg.is_national_holiday, reg.national_holiday_name) == (0, 1, 1, 0, "")
    assert reg.is_holiday == 0 and nat.is_holiday == 1


def test_bank_closures(spark):
    c = build(spark, [HolidayRule("x", easter_offset=-2)])
    assert c[dt.date(2024, 3, 28)].is_bank_holiday == 1  # the day before Good Friday
    assert c[dt.date(2024, 12, 24)].bank_holiday_A == c[dt.date(2024, 12, 31)].bank_holiday_A == 1
    assert c[dt.date(2024, 6, 2)].is_bank_holiday == 1 and c[dt.date(2024, 6, 1)].is_bank_holiday == 0  # Sunday, Saturday
    assert build(spark, [HolidayRule("x", easter_offset=-2)], holy_thursday=False)[dt.date(2024, 3, 28)].is_bank_holiday == 0


def test_leap_day_rule_and_quoted_names(spark):
    c = build(spark, [HolidayRule("St John's \\ day", 2, 29)], ys=(2023, 2024))
    assert c[dt.date(2024, 2, 29)].national_holiday_name == "St John's \\ day"
    assert sum(r.is_national_holiday for r in c.values()) == 1 and len(c) == 365 + 366


def test_spanish_calendar_shape(spark):
    df = cal.calendar_features(years(spark, 2026), SPAIN_RULES, CALENDAR_REGIONS)
    assert len(df.columns) == 71 and df.count() == 365
    rows = {r.date: r for r in df.collect()}
    assert rows[dt.date(2026, 4, 3)].num_regions_holiday == 19
    assert rows[dt.date(2026, 4, 2)].holiday_MD == 1 and rows[dt.date(2026, 4, 2)].holiday_CT == 0
    assert rows[dt.date(2026, 4, 6)].holiday_CT == 1
    b = cal.holiday_breakdown(df).first()
    assert b.holiday_days + b.working_days == 365
    assert b.weekend_only + b.national_on_weekday + b.national_on_weekend == b.holiday_days


@pytest.mark.parametrize("day,name", [(dt.date(2024, 1, 1), "dow_Monday"), (dt.date(2024, 1, 7), "dow_Sunday")])
def test_weekday_columns(spark, day, name):
    row = build(spark, [HolidayRule("n", 1, 1)])[day]
    assert row[name] == 1 and sum(v for k, v in row.asDict().items() if k.startswith("dow_")) == 1
