"""Calendar, holiday, bank-holiday and bridge-day features from a rule list."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import timeparts as t


@dataclass(frozen=True)
class HolidayRule:
    """A fixed (month, day) or a day counted from Easter Sunday; no region = national."""

    name: str
    month: int | None = None
    day: int | None = None
    easter_offset: int | None = None
    region: str | None = None


def easter_sunday(year: str = "year") -> str:
    """Gregorian Easter of a year column (the anonymous computus), as a SQL expression."""
    a, b, c = f"({year} % 19)", f"({year} div 100)", f"({year} % 100)"
    g = f"(({b} - ({b} + 8) div 25 + 1) div 3)"
    h = f"((19 * {a} + {b} - {b} div 4 - {g} + 15) % 30)"
    l = f"((32 + 2 * ({b} % 4) + 2 * ({c} div 4) - {h} - {c} % 4) % 7)"
    m = f"(({a} + 11 * {h} + 22 * {l}) div 451)"
    n = f"({h} + {l} - 7 * {m} + 114)"
    return f"make_date({year}, cast({n} div 31 as int), cast({n} % 31 + 1 as int))"


def years_of(df: DataFrame, ts: str) -> DataFrame:
    """The distinct years of a time column."""
    return df.select(F.year(ts).alias("year")).where("year is not null").distinct()


def _text(value: str | None) -> str:
    if value is None:
        return "cast(null as string)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def holidays(years: DataFrame, rules: Sequence[HolidayRule]) -> DataFrame:
    """(date, national flag, national names, regions on holiday): one row per holiday date.

    The rules are a literal list unfolded on each year, so no join is needed.
    """
    entries = []
    for r in rules:
        if r.easter_offset is not None:
            date = f"date_add(easter, {r.easter_offset})"
        else:
            # 29 February exists in leap years only
            first = f"make_date(year, {r.month}, 1)"
            date = f"case when day(last_day({first})) >= {r.day} then date_add({first}, {r.day - 1}) end"
        entries.append(f"struct({date} as date, {_text(r.name)} as name, {_text(r.region)} as region)")
    dated = years.selectExpr("year", f"{easter_sunday()} as easter").selectExpr(f"inline(array({', '.join(entries)}))")
    return (
        dated.where("date is not null")
        .groupBy("date")
        .agg(
            F.expr("max(cast(region is null as int))").alias("is_national"),
            F.expr("array_join(sort_array(collect_set(case when region is null then name end)), '; ')").alias("national_name"),
            F.expr("collect_set(region)").alias("regions"),
        )
    )


def calendar_features(
    years: DataFrame, rules: Sequence[HolidayRule], regions: Sequence[str], holy_thursday: bool = True
) -> DataFrame:
    """One row per day of each year in `years`.

    A region's holidays include the national ones.  Bank holidays add Sundays,
    24 and 31 December and (unless switched off) the day before Good Friday.
    A bridge day is a Monday before, or a Friday after, a regional holiday of
    the same year.
    """
    spine = years.selectExpr(
        "year",
        f"date_add({easter_sunday()}, -3) as thursday",
        "explode(sequence(make_date(year, 1, 1), make_date(year, 12, 31))) as date",
    )
    joined = spine.join(holidays(years, rules), "date", "left")
    days = joined.selectExpr(
        "date",
        "year",
        "thursday",
        "weekday(date) as dow",
        "coalesce(is_national, 0) as is_national_holiday",
        "coalesce(national_name, '') as national_holiday_name",
        "coalesce(regions, cast(array() as array<string>)) as regions",
    )
    around = "over (partition by year order by date)"
    days = days.selectExpr(
        "*",
        *[f"{f}({c}) {around} as {n}_{c}" for f, n in (("lead", "next"), ("lag", "prev")) for c in ("is_national_holiday", "regions")],
    )
    closed = "(dow = 6 or (month(date) = 12 and day(date) in (24, 31))" + (" or date = thursday)" if holy_thursday else ")")

    def flag(condition: str) -> str:
        return f"cast(coalesce({condition}, false) as int)"

    def on_holiday(region: str, day: str = "") -> str:
        return f"({day}is_national_holiday = 1 or array_contains({day}regions, {_text(region)}))"

    out = {f"holiday_{r}": flag(on_holiday(r)) for r in regions}
    out |= {f"bank_holiday_{r}": flag(f"{on_holiday(r)} or {closed}") for r in regions}
    out["is_bank_holiday"] = flag(f"is_national_holiday = 1 or {closed}")
    for r in regions:
        monday, friday = f"dow = 0 and {on_holiday(r, 'next_')}", f"dow = 4 and {on_holiday(r, 'prev_')}"
        out[f"bridge_{r}"] = f"greatest({flag(monday)}, {flag(friday)})"
    out["num_regions_holiday"] = " + ".join(flag(on_holiday(r)) for r in regions)
    out |= {f"dow_{name}": flag(f"dow = {i}") for i, name in enumerate(t.DAY_NAMES)}
    out["is_weekend"] = flag("dow >= 5")
    out["is_holiday"] = flag("dow >= 5 or is_national_holiday = 1")
    return days.selectExpr(
        "date", "is_national_holiday", "national_holiday_name", *[f"{e} as `{n}`" for n, e in out.items()]
    )


def holiday_breakdown(calendar: DataFrame) -> DataFrame:
    """How many days are weekend, holiday, both, either or neither."""
    we, nat, hol = (F.col(c) == 1 for c in ("is_weekend", "is_national_holiday", "is_holiday"))
    return calendar.agg(
        F.count_if(we & ~nat).alias("weekend_only"),
        F.count_if(~we & nat).alias("national_on_weekday"),
        F.count_if(we & nat).alias("national_on_weekend"),
        F.count_if(hol).alias("holiday_days"),
        F.count_if(~hol).alias("working_days"),
    )
