from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loadweave.operators import region as rg, weather as wx
from loadweave.sources import dimensions as dim, readers


def test_station_files_are_read_tagged_and_cleaned(spark, tmp_path):
    records = [
        {"fecha": "2025-01-01", "indicativo": "3129", "tmed": "3,4", "prec": "Ip", "horatmax": "Varias"},
        {"fecha": "2025-01-02", "indicativo": "3129", "tmed": " 12,0 ", "prec": "0,0"},
        {"fecha": "not a date", "indicativo": "1082", "tmed": "1,0"},
        {"fecha": "2025-01-03", "indicativo": "9999", "tmed": "Acum"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(records))
    rows = wx.clean_stations(readers.read_stations(spark, str(tmp_path))).orderBy("fecha").collect()
    assert [(r.fecha, r.community_code, r.tmed, r.prec, r.horatmax) for r in rows] == [
        (dt.date(2025, 1, 1), "MD", 3.4, None, "Varias"),
        (dt.date(2025, 1, 2), "MD", 12.0, 0.0, None),
        (dt.date(2025, 1, 3), None, None, None, None),
    ]


def test_hourly_documents_flatten_and_lose_empty_columns(spark, tmp_path):
    for code, temps in (("MD", [1.5, None]), ("CT", [2.5, 3.5])):
        doc = {
            "community_code": code, "latitude": 40.4, "longitude": -3.7, "elevation": 650.0,
            "hourly": {"time": ["2025-01-01T00:00", "2025-01-01T01:00"], "temperature_2m": temps, "snow_depth": [None, None]},
        }
        (tmp_path / f"{code}.json").write_text(json.dumps(doc))
    docs = readers.read_hourly_documents(spark, str(tmp_path), ["temperature_2m", "snow_depth"])
    flat = wx.flatten_hourly(docs)
    assert flat.count() == 4 and dict(flat.dtypes)["datetime_local"] == "timestamp_ntz"
    assert [(r.column_name, r.null_count, r.null_pct) for r in wx.partial_null_report(flat).collect()] == [("temperature_2m", 1, 25.0)]
    assert "snow_depth" not in wx.drop_empty_columns(flat).columns
    assert "snow_depth" in wx.drop_empty_columns(flat, keep=["snow_depth"]).columns
    mean = {r.datetime_local.hour: r.temperature_2m for r in wx.spatial_mean(flat, ["temperature_2m"]).collect()}
    assert mean == {0: 2.0, 1: 3.5}


def test_missing_temperature(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1), 10.0), (dt.datetime(2025, 1, 2), None), (dt.datetime(2025, 1, 3), 30.0)], "datetime_local timestamp_ntz, temperature_2m double")
    safe = [(r.hdd_hourly, r.cdd_hourly) for r in rg.degree_hours(df).orderBy("date").collect()]
    assert safe == [(8.0, 0.0), (None, None), (0.0, 8.0)]
    zero = [(r.hdd_hourly, r.cdd_hourly) for r in rg.degree_hours(df, null_as_zero=True).orderBy("date").collect()]
    assert zero[1] == (0.0, 0.0)
    assert rg.degree_hours(df, "2025-01-01", "2025-01-02").count() == 2


def test_unmapped_community_stays_in_the_mean_but_not_in_the_totals(spark):
    rows = [("MD", dt.datetime(2025, 1, 1), 8.0), ("EX", dt.datetime(2025, 1, 1), 10.0)]
    hours = rg.degree_hours(spark.createDataFrame(rows, "community_code string, datetime_local timestamp_ntz, temperature_2m double"))
    mapped = rg.map_codes(hours, dim.COMMUNITY_NUTS2, "community_code", "nuts2_code")
    assert [(r.nuts2_code, r.hdd) for r in rg.degree_totals(mapped).collect()] == [("ES30", 10.0)]
    assert wx.daily_mean(mapped, ["hdd_hourly"]).first().hdd_hourly == 9.0
    full = rg.map_codes(hours, dim.COMMUNITY_NUTS2_FULL, "community_code", "nuts2_code")
    assert {r.nuts2_code for r in rg.degree_totals(full).collect()} == {"ES30", "ES43"}
    assert [r.community_code for r in rg.missing_codes(hours, dim.COMMUNITY_NUTS2, "community_code").collect()] == ["EX"]
    assert {r.nuts2_code for r in rg.regions_without_data(mapped, ["ES30", "ES43"]).collect()} == {"ES43"}


def test_urban_classes(spark):
    df = spark.createDataFrame([(1501.0,), (1500.0,), (300.5,), (300.0,), (None,)], "d double")
    out = df.select(rg.urban_class(F.col("d")).alias("urban_rural_class")).withColumns(rg.urban_one_hot()).collect()
    assert [r[0] for r in out] == ["urban", "intermediate", "intermediate", "rural", "unknown"]
    assert all(r[f"is_{r[0]}"] == 1 and sum(r[1:]) == 1 for r in out)


def test_statistics_file_to_latest_year(spark, tmp_path):
    (tmp_path / "p.csv").write_text("geo,sex,age,2022,2023\nES30,T,TOTAL,10,20\nES11,T,TOTAL,5,:\nFR1,T,TOTAL,7,7\nES30,F,TOTAL,1,1\n")
    raw = readers.read_statistics(spark, str(tmp_path / "p.csv"), ["geo", "sex", "age"], [2022, 2023])
    kept = rg.keep_codes(raw, "geo", list(dim.NUTS2_NAMES), {"sex": "T", "age": "TOTAL", "unit": "NR"})
    assert sorted(map(tuple, rg.latest_year(kept, ["geo"]).collect())) == [("ES11", None), ("ES30", 20.0)]
    with pytest.raises(ValueError):
        rg.latest_year(raw.select("geo"), ["geo"])


def test_latest_year_of_a_long_table(spark):
    df = spark.createDataFrame([("a", 2022, 1.0), ("a", 2023, 2.0), ("b", 2022, 3.0)], "k string, year int, v double")
    assert [tuple(r) for r in rg.latest_year_long(df).collect()] == [("a", 2023, 2.0)]


def test_unit_fallback(spark):
    pop = spark.createDataFrame([("x", 100)], "nuts2_code string, population bigint")

    def value(rows):
        return rg.gdp_per_capita(spark.createDataFrame(rows, "nuts2_code string, unit string, value double"), pop).collect()

    assert [r.gdp_per_capita_eur for r in value([("x", "MIO_EUR", 5.0), ("x", "EUR_HAB", 7.0)])] == [7.0]
    assert [r.gdp_per_capita_eur for r in value([("x", "MIO_EUR", 5.0), ("x", "AAA", 7.0)])] == [50000.0]
    assert [r.gdp_per_capita_eur for r in value([("x", "ZZZ", 5.0), ("x", "AAA", 7.0)])] == [7.0]


def test_min_max_of_equal_values(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 2.0)], "k string, v double")
    assert [r.v_normalized for r in rg.min_max(df, {"v": 0.5}).collect()] == [0.5] * 3
    assert [r.v_normalized for r in rg.min_max(df, {"v": None}).collect()] == [None] * 3


def test_shares_and_tourism_with_missing_parts(spark):
    gva = spark.createDataFrame(
        [("a", "TOTAL", 10.0), ("a", "B-E", 4.0), ("b", "TOTAL", 0.0), ("b", "A", 1.0), ("c", "A", 1.0)],
        "nuts2_code string, nace_r2 string, value double",
    )
    got = {r.nuts2_code: (r.ind, r.agr) for r in rg.sector_shares(gva, {"ind": "B-E", "agr": "A"}).collect()}
    assert got == {"a": (0.4, None), "b": (None, None)}
    nights = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", None), ("c", 5.0), ("d", 900.0)], "nuts2_code string, nights double")
    pop = spark.createDataFrame([("a", 10), ("b", 10), ("d", 10)], "nuts2_code string, population bigint")
    t = {r.nuts2_code: (r.tourism_nights_per_capita, r.is_holiday_destination) for r in rg.tourism_features(nights, pop).collect()}
    assert t == {"a": (3.0, 0), "b": (0.0, 0), "c": (None, 0), "d": (90.0, 1)}


def test_lookup_tables_agree(spark):
    assert {n: f.count() for n, f in dim.frames(spark).items()} == {"stations": 18, "coordinates": 18, "regions": 19, "codes": 18}
    assert set(dim.NUTS2_AREA) == set(dim.NUTS2_NAMES) and len(dim.NUTS2_NAMES) == 19
    assert set(dim.COMMUNITY_NUTS2_FULL) == set(dim.STATIONS) == set(dim.COORDINATES)
    assert len(dim.CALENDAR_REGIONS) == 19 and set(dim.STATIONS) < set(dim.CALENDAR_REGIONS)
