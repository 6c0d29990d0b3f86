"""Every operator as a query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import timeparts as t
from ..operators import calendar as cal
from ..operators import encode, feeds as fd, grid, lags, profile, quality, region, rollup as ru, sampling, scale, weather as wx
from ..plans import boosting, evaluate as ev, features as ft, forecast as fc, linear
from ..session import ensure_checkpoint_dir, materialize, store
from ..sources import dimensions, readers, sinks
from . import inputs as i

CC = ["community_code"]
D = 2  # decimals of the readings: sums run on whole hundredths
E = 6  # decimals kept in error sums
BUCKETS = 8
START, END = i.HOLDOUT_START, i.HOLDOUT_END


def _total(s: SparkSession, d: str, out: str = "total_kw") -> DataFrame:
    return ru.rollup(i.meter(s, d), out=out, decimals=D)


def _community(s: SparkSession, d: str) -> DataFrame:
    return ru.rollup(i.meter(s, d), "15min", CC, decimals=D)


def _plain(grain: str, keys: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: ru.rollup(i.meter(s, d), grain, keys, decimals=D)


def _with_feeds(s: SparkSession, d: str, keys: list[str]) -> DataFrame:
    slots = ru.rollup(i.meter(s, d), "15min", keys, decimals=D)
    return fd.join_feeds(slots, i.feeds(s, d))


def month_pivot(s, d):
    return ru.month_pivot(i.meter(s, d), i.COMMUNITIES, decimals=D)


def daily_profile(s, d):
    return profile.wide_profiles(i.meter(s, d), decimals=D)


def client_daily_profile(s, d):
    return profile.wide_profiles(i.meter(s, d), ["client_id", "community_code"], fill=0.0, decimals=D)


def community_daily_profile(s, d):
    return profile.wide_profiles(i.meter(s, d), CC, fill=0.0, decimals=D)


def feed_profile(s, d):
    return profile.feed_profile(fd.merge_feeds(i.feeds(s, d)))


def daily_conditions(s, d):
    return profile.daily_conditions(_with_feeds(s, d, []), decimals=D)


def client_conditions(s, d):
    return profile.daily_conditions(_with_feeds(s, d, ["client_id", "community_code"]), ["client_id"], decimals=D, full=False)


def client_conditioned_profiles(s, d):
    keys = ["client_id", "community_code"]
    out = profile.conditioned_profiles(_with_feeds(s, d, keys), keys, decimals=D, full=False)
    return profile.to_wide(out)


def day_conditioned_profiles(s, d):
    return profile.to_wide(profile.conditioned_profiles(_with_feeds(s, d, []), decimals=D, complete=False))


def client_scaled_profiles(s, d):
    """Each client's loads in the scale of the client's own days before the cut, slot by slot."""
    # the filled slots go to their client once; grouping, fitting and joining find them there, and no row of a zero moves
    slots = ru.rollup(i.meter(s, d), "15min", ["client_id"], decimals=D).repartition("client_id")
    days, keys = profile.daily_arrays(slots, ["client_id"], fill=0.0), ["client_id", "interval_idx"]
    stats = scale.fit_groups(days.where(F.col("date") < "2024-01-24"), keys, "kw", decimals=D, profile="profile")
    return scale.scale_groups(days, stats, keys, "kw", profile="profile")


def baseline_scaled(s, d):
    """The baseline in the scale of the loads that it stands for, slot by slot."""
    slots = _community(s, d)
    keys = ["community_code", "interval_idx"]
    rows = profile.to_long(profile.daily_arrays(slots, CC, fill=0.0), value="kw")
    base = profile.median_baseline(slots).select("community_code", "day_of_week", "interval_idx", "hist")
    return scale.scale_groups(base, scale.fit_groups(rows, keys, "kw", decimals=D), keys, "hist")


def condition_one_hot(s, d):
    days = profile.daily_conditions(_with_feeds(s, d, []), decimals=D)
    return days.select("date", *[c.alias(n) for n, c in encode.calendar_one_hot().items()])


def median_baseline(s, d):
    return profile.median_baseline(_community(s, d), recent_from="2024-01-15")


def median_baseline_exact(s, d):
    out = profile.median_baseline(_community(s, d), recent_from="2024-01-15", exact=True)
    return out.withColumns({c: F.round(c, 4) for c in ("hist_global", "hist_recent", "hist")})


def baseline_on_slots(s, d):
    slots = materialize(_community(s, d))
    return profile.attach_baseline(slots, profile.median_baseline(slots))


def weekday_lag_profiles(s, d):
    days = materialize(profile.daily_arrays(_total(s, d), value="total_kw", fill=0.0))
    out = profile.weekday_lag_profiles(days)
    for c in ("profile", "lag7", "lag14"):
        out = profile.to_wide(out, c, prefix=f"{c}_")
    return out


def clock_lags(s, d):
    return lags.clock_lags(_total(s, d), {"lag_1d": 1, "lag_7d": 7, "lag_2d": 2, "lag_3d": 3}, value="total_kw")


def row_lags(s, d):
    return lags.row_lags(_total(s, d), {"lag_1d": 96, "lag_7d": 672, "lag_2d": 192, "lag_3d": 288})


def next_day_target(s, d):
    return lags.next_day_target(_community(s, d))


def rolling_prev7d(s, d):
    out = lags.rolling_previous_week(_total(s, d), decimals=D)
    return out.withColumn("rolling_std_7d", F.round("rolling_std_7d", 6))


def rolling_safe(s, d):
    return lags.rolling_week_inclusive(_total(s, d, "demand_kw"), decimals=D)


def lagged_demand(s, d):
    return lags.lagged_demand(_total(s, d, "demand_kw"), grid.slot_grid(s, START, END), decimals=D)


def lagged_demand_10d(s, d):
    return lags.lagged_demand(_total(s, d, "demand_kw"), grid.slot_grid(s, START, END), availability_lag_days=10, decimals=D)


def upsample_carry(s, d):
    return ft.weather_slots(i.weather(s, d), decimals=D)


def feed_slots(s, d):
    # the feed twice over, the second time a little higher: copies of a stamp
    feed = i.feeds(s, d)["pv_fc"]
    doubled = feed.unionByName(feed.withColumn("value", F.col("value") + 1.0))
    return fd.feed_slots(doubled, "pv_forecast")


def feeds_outer(s, d):
    return fd.merge_feeds(i.feeds(s, d))


def feed_join(s, d):
    return _with_feeds(s, d, [])


def spatial_mean(s, d):
    return wx.spatial_mean(i.weather(s, d), ft.WEATHER, decimals=D)


def _years(s, d):
    years = cal.years_of(i.table(s, d, "orders"), "o_orderdate")
    return years.unionByName(cal.years_of(i.table(s, d, "events"), "ts"))


def calendar_features(s, d):
    return cal.calendar_features(_years(s, d), i.RULES, i.COMMUNITIES)


def holiday_breakdown(s, d):
    return cal.holiday_breakdown(calendar_features(s, d))


def _hours(s, d):
    return region.degree_hours(i.weather(s, d))


def _regional_hours(s, d):
    return region.map_codes(_hours(s, d), i.COMMUNITY_REGION, "community_code", "nuts2_code")


def degree_hours(s, d):
    # the days asked for are this operator's feature; all others work on every hour
    hours = region.degree_hours(i.weather(s, d), "2024-01-02", "2024-01-29")
    return hours.select("datetime_local", "date", "community_code", "temperature_2m", "hdd_hourly", "cdd_hourly")


def degree_hours_null_as_zero(s, d):
    out = region.degree_hours(i.weather(s, d), null_as_zero=True)
    return out.select("datetime_local", "community_code", "hdd_hourly", "cdd_hourly")


def degree_daily_mean(s, d):
    return wx.daily_mean(_hours(s, d), ft.DEGREES, decimals=D)


def _degree_index(s, d):
    sums = region.degree_totals(_regional_hours(s, d), decimals=D)
    return region.min_max(sums, {"hdd": 0.5, "cdd": 0.5})


def degree_monthly(s, d):
    return region.degree_totals_monthly(_regional_hours(s, d), decimals=D)


def region_month_pattern(s, d):
    return region.region_month_pattern(_regional_hours(s, d), decimals=D, day_decimals=E)


def degree_summary(s, d):
    return region.degree_summary(_regional_hours(s, d), decimals=D)


def region_temporal(s, d):
    return region.temporal_features(_regional_hours(s, d))


def missing_codes(s, d):
    return region.missing_codes(i.meter(s, d), i.COMMUNITY_REGION, "community_code")


def regions_without_data(s, d):
    return region.regions_without_data(_regional_hours(s, d), ["ES11", "ES12", "ES13", "ES24", "ES61"])


def _gva(s, d, totals=None):
    return region.latest_year(i.sector_values(s, d, totals), ["nuts2_code", "nace_r2"])


def latest_year(s, d):
    return _gva(s, d)


def sector_shares(s, d, gva=None):
    gva = _gva(s, d) if gva is None else gva
    shares = region.sector_shares(gva, {"industrial_index": "MACHINERY", "agricultural_share": "FURNITURE"})
    return region.min_max(shares, {"industrial_index": None, "agricultural_share": None})


def density(s, d, population=None):
    return region.density_features(i.population(s, d) if population is None else population, i.area(s, d))


def density_class_counts(s, d):
    return region.class_counts(density(s, d), "urban_rural_class")


def tourism(s, d, totals=None, population=None):
    return region.tourism_features(i.nights(s, d, totals), i.population(s, d) if population is None else population, decimals=0)


def gdp_per_capita(s, d, gva=None, population=None):
    # totals in millions only, so the per-inhabitant figure has to be computed
    gva = _gva(s, d) if gva is None else gva
    gdp = gva.where("nace_r2 = 'TOTAL'").select("nuts2_code", F.lit("MIO_EUR").alias("unit"), (F.col("value") / 1e6).alias("value"))
    out = region.gdp_per_capita(gdp, i.population(s, d) if population is None else population)
    return region.min_max(out, {"gdp_per_capita_eur": None}).withColumnRenamed("gdp_per_capita_eur_normalized", "gdp_per_capita_normalized")


def gdp_extremes(s, d):
    return region.extremes(gdp_per_capita(s, d), "nuts2_code", "gdp_per_capita_eur")


def region_static(s, d):
    # the degree totals of the regions with weather, keyed by nation for the chain
    degrees = _degree_index(s, d)
    codes = {"ES61": "NATION_0", "ES24": "NATION_1", "ES12": "NATION_2", "ES13": "NATION_3"}
    degrees = region.map_codes(degrees.withColumnRenamed("nuts2_code", "es"), codes, "es", "nuts2_code").drop("es")
    # both are as small as nations x segments; all branches read them instead of the orders
    totals, population = materialize(i.order_totals(s, d)), materialize(i.population(s, d))
    gva = _gva(s, d, totals)
    shares, gdp = sector_shares(s, d, gva), gdp_per_capita(s, d, gva, population)
    return region.static_features(density(s, d, population), population, tourism(s, d, totals, population), gdp, shares, degrees)


def _nation_hours(s, d):
    codes = dict(zip(i.COMMUNITIES, ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_7"], strict=True))
    return region.temporal_features(region.map_codes(_hours(s, d), codes, "community_code", "nuts2_code"))


def temporal_with_static(s, d):
    static = density(s, d).select("nuts2_code", "population_density", "urban_rural_class")
    return region.with_static(_nation_hours(s, d), static)


def weather_clean(s, d):
    return wx.clean_stations(i.stations(s, d))


def station_daily_mean(s, d):
    return wx.daily_mean(wx.clean_stations(i.stations(s, d)), ["tmed", "prec", "velmedia"], "fecha", D)


def hourly_flatten(s, d):
    return wx.drop_empty_columns(wx.flatten_hourly(i.weather_documents(s, d)))


def hourly_from_json(s, d):
    """The documents as JSON text, parsed under the explicit schema."""
    texts = i.weather_documents(s, d).select(F.to_json(F.struct("*")).alias("text"))
    docs = readers.parse_hourly_documents(texts, "text", ["temperature_2m", "cloud_cover", "snow_depth"])
    return wx.drop_empty_columns(wx.flatten_hourly(docs))


def stations_from_json(s, d):
    """Station records as JSON text, parsed and tagged with their community, cleaned and averaged."""
    codes = F.concat(F.lit("ST_"), F.col("community_code")).alias("indicativo")
    texts = i.stations(s, d).select(F.to_json(F.struct(codes, "fecha", "tmed", "prec", "velmedia", "horatmax")).alias("text"))
    raw = readers.parse_stations(texts, "text", {c: (f"ST_{c}", c) for c in i.COMMUNITIES})
    return wx.daily_mean(wx.clean_stations(raw).where("community_code is not null"), ["tmed", "prec", "velmedia"], "fecha", D)


def statistics_from_csv(s, d):
    """The wide sector table as lines of text, parsed and reduced to its latest year."""
    wide = i.sector_values(s, d)
    dims, years = ["nuts2_code", "nace_r2"], [c for c in wide.columns if c.isdigit()]
    lines = wide.select(F.to_csv(F.struct(*dims, *years), {"sep": ";"}).alias("line"))
    return region.latest_year(readers.parse_statistics(lines, "line", dims, years, ";"), dims)


def null_report(s, d):
    return wx.partial_null_report(wx.flatten_hourly(i.weather_documents(s, d)))


def cyclic_features(s, d):
    out = ft.seasonal(_total(s, d))
    out = out.withColumn("is_weekend", t.is_weekend("datetime_15min"))
    # + 0.0 turns a negative zero into zero
    return out.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in out.columns if c.endswith(("_sin", "_cos"))})


def time_parts(s, d):
    slots = _total(s, d).select("datetime_15min")
    return slots.select(
        "datetime_15min",
        F.to_date("datetime_15min").alias("date"),
        t.week_start("datetime_15min").alias("week_start"),
        t.month_start("datetime_15min").alias("month_start"),
        F.hour("datetime_15min").alias("hour"),
        F.minute("datetime_15min").alias("minute"),
        F.dayofmonth("datetime_15min").alias("day_of_month"),
        F.month("datetime_15min").alias("month"),
        F.year("datetime_15min").alias("year"),
        t.interval_idx("datetime_15min").alias("interval_idx"),
        t.quarter_of_hour("datetime_15min").alias("quarter_of_hour"),
        t.dow_mon0("datetime_15min").alias("dow_mon0"),
        t.dow_sun1("datetime_15min").alias("dow_sun1"),
        t.mon0_to_sun1(t.dow_mon0("datetime_15min")).alias("dow_from_mon0"),
        t.day_name("datetime_15min").alias("day_name"),
    )


def _long_profiles(s, d):
    return profile.to_long(profile.daily_arrays(materialize(_community(s, d)), CC, fill=0.0), value="kw")


def _roundtrip(s, d, log: bool):
    rows, keys = _long_profiles(s, d), ["community_code", "interval_idx"]
    stats = scale.fit_groups(rows.where(F.col("date") < "2024-01-24"), keys, "kw", log)
    out = scale.unscale_groups(scale.scale_groups(rows, stats, keys, "kw", log=log), stats, keys, log=log)
    return out.withColumns({"scaled": F.round("scaled", 5) + F.lit(0.0), "restored": F.round("restored", 4) + F.lit(0.0)})


def scaled_columns(s, d):
    rows = materialize(fd.merge_feeds(i.feeds(s, d)))
    train = rows.where(F.col("datetime_local") < t.ntz(START))
    out = scale.scale_columns(rows, train, ["demand_fc", "pv_fc", "wind_fc"])
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in out.columns if c.endswith("_scaled")})


def imputed_features(s, d):
    feed = materialize(fd.merge_feeds(i.feeds(s, d)))
    train = feed.where(F.col("datetime_local") < t.ntz(START)).dropna()
    rows = feed.where(F.col("datetime_local") >= t.ntz(START))
    out = quality.impute_medians(rows, train, ["demand_fc", "pv_fc", "wind_fc"])
    return out.withColumns({c: F.round(c, 4) for c in ("demand_fc", "pv_fc", "wind_fc")})


def label_ids(s, d):
    return encode.label_ids(i.meter(s, d), "client_id", "client_idx")


def hashed_label_ids(s, d):
    """Ids spread over the whole range of a long."""
    spread = i.meter(s, d).select((F.col("client_id") * F.lit(2654435761) % F.lit(1 << 40)).alias("hashed_id"))
    return encode.label_ids(spread, "hashed_id", "client_idx")


def community_labels(s, d):
    return encode.label_codes(i.meter(s, d), "community_code", "community_idx")


def label_cardinality(s, d):
    return encode.cardinality(label_ids(s, d), "client_idx", "num_clients")


def community_codes(s, d):
    return readers.query(s, "select distinct community_code from {readings}", readings=i.meter(s, d))


def client_sample(s, d):
    return sampling.sample_entities(i.meter(s, d), "client_id", 0.3, portable=True)


def row_sample(s, d):
    slots = _community(s, d)
    return sampling.sample_rows(slots, ["community_code", "datetime_15min"], 0.5, portable=True)


def rows_at_most(s, d):
    slots = materialize(_community(s, d))
    return sampling.sample_at_most(slots, 500, ["community_code", "datetime_15min"], portable=True)


def random_split(s, d):
    train, test = sampling.random_split(next_day_target(s, d), ["community_code", "datetime_15min"], 0.8, portable=True)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _exogenous(s, d) -> dict:
    """What a forecast is given beside the readings."""
    names = dict(zip(("demand_fc", "pv_fc", "wind_fc"), ft.FEEDS, strict=True))
    return {
        "weather": i.weather(s, d),
        "degrees": region.degree_hours(i.weather(s, d)),
        "feeds": {names[k]: v for k, v in i.feeds(s, d).items()},
        "calendar": cal.calendar_features(cal.years_of(i.table(s, d, "events"), "ts"), i.RULES, i.COMMUNITIES),
    }


def matrix(s, d) -> DataFrame:
    # only readings before the end of the period can be features or targets of it
    demand = ft.demand_series(fc.before(i.meter(s, d), END), D)
    return ft.feature_matrix(demand, **_exogenous(s, d), start=START, end=END, decimals=D)


def feature_matrix(s, d):
    out = matrix(s, d)
    return out.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in out.columns if c.endswith(("_sin", "_cos"))})


def naive_forecast(s, d):
    return fc.forecast(i.meter(s, d), START, END, "naive", decimals=D)


def naive_long_horizon(s, d):
    return fc.forecast(i.meter(s, d), "2024-01-15 00:00:00", "2024-02-05 00:00:00", "naive", decimals=D)


def naive_week_ago(s, d):
    return fc.forecast(i.meter(s, d), "2024-01-15 00:00:00", "2024-02-05 00:00:00", "naive", day_by_day=True, decimals=D)


def naive_no_history(s, d):
    return fc.forecast(i.meter(s, d), "2024-01-01T00:00:00", "2024-01-03T00:00:00", "naive", decimals=D)


def median_no_history(s, d):
    return fc.forecast(i.meter(s, d), "2024-01-01T00:00:00", "2024-01-03T00:00:00", "median", decimals=D)


def median_forecast(s, d):
    return fc.forecast(i.meter(s, d), START, END, "median", decimals=D)


def _pairs(s, d):
    return ev.matched(naive_forecast(s, d), ev.actuals(i.meter(s, d), START, END, decimals=D))


def holdout_mae(s, d):
    return ev.holdout_mae(_pairs(s, d), E)


def holdout_mae_median(s, d):
    return ev.holdout_mae(ev.matched(median_forecast(s, d), ev.actuals(i.meter(s, d), START, END, decimals=D)), E)


def accuracy(s, d):
    return ev.accuracy(_pairs(s, d), E).withColumn("r2", F.round("r2", 6))


def bias_summary(s, d):
    out = ev.bias_summary(_pairs(s, d), E)
    return out.withColumns({c: F.round(c, 6) for c in ("actual_std", "prediction_std")})


def error_by_hour(s, d):
    return ev.error_by_hour(_pairs(s, d), E)


def error_by_weekday(s, d):
    return ev.error_by_weekday(_pairs(s, d), E)


def daily_error(s, d):
    return ev.daily_error(_pairs(s, d), E)


def daily_error_summary(s, d):
    return ev.daily_error_summary(daily_error(s, d), E).withColumn("pct_bias_std", F.round("pct_bias_std", 6))


def weekly_drift(s, d):
    pairs = ev.matched(naive_long_horizon(s, d), ev.actuals(i.meter(s, d), "2024-01-15 00:00:00", "2024-02-05 00:00:00", decimals=D))
    return ev.weekly_drift(materialize(pairs), E)


def verdict(s, d):
    pairs = materialize(_pairs(s, d))
    out = ev.verdict(ev.daily_error(pairs, E), ev.weekly_drift(pairs, E))
    return out.withColumns({c: F.round(c, 6) for c in ("bias_std", "drift")})


def profile_table(s, d):
    return quality.table_profile(
        i.weather(s, d),
        "datetime_local",
        "community_code",
        {"avg_temp_c": "temperature_2m", "avg_cloud": "cloud_cover"},
        {"total_dew": "dew_point_2m"},
        decimals=D,
    )


def meter_overview(s, d):
    return quality.meter_overview(i.meter(s, d))


def describe(s, d):
    out = quality.describe(i.meter(s, d), ["client_id", "active_kw"], decimals=D)
    return out.withColumns({c: F.round(c, 4) for c in ("std", "p25", "p50", "p75")})


def table_head(s, d):
    return quality.head_rows(i.weather(s, d), ["community_code", "datetime_local"])


def density_ranked(s, d):
    return quality.ranked(density(s, d), "population_density", "nuts2_code")


def submission(s, d):
    return sinks.submission(naive_forecast(s, d), "spark_team").drop("submitted_at")


def _own_folder(s: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(s)}/tables-{uuid.uuid4().hex}"


def submission_written(s, d):
    """The submission table as it was written; every row has the time of this run."""
    before, target = F.lit(s.sql("select current_timestamp()").first()[0]), f"{_own_folder(s)}/submission"
    sinks.write_submission(naive_forecast(s, d), "spark_team", target)
    stamp = F.col("submitted_at")
    return s.read.parquet(target).withColumn("in_this_run", stamp.isNotNull() & (stamp >= before) & (stamp <= F.current_timestamp())).drop("submitted_at")


def grains_written(s, d):
    """Slots and hours as bucketed tables, read back and joined without a shuffle."""
    keys, name = ["community_code", "datetime_hour"], f"loadweave_{uuid.uuid4().hex}"
    slots = _community(s, d).withColumn("datetime_hour", t.slot_start("datetime_15min", 60))
    hours = ru.rollup(i.meter(s, d), "hour", CC, out="hour_kw", decimals=D)
    folder = _own_folder(s)
    left = sinks.write_bucketed(slots, f"{name}_slots", keys, BUCKETS, f"{folder}/slots")
    right = sinks.write_bucketed(hours, f"{name}_hours", keys, BUCKETS, f"{folder}/hours")
    return left.join(right, keys).drop("datetime_hour")


def temporal_partitions(s, d):
    """Hourly features by region and month; one region comes again, a degree warmer, and replaces its own partitions only."""
    parts = ["nuts2_code", "month"]
    hours = _nation_hours(s, d).withColumn("month", F.year("date") * 100 + F.month("date"))
    path = f"{_own_folder(s)}/temporal"
    sinks.overwrite_partitions(hours, path, parts)
    sinks.overwrite_partitions(hours.where("nuts2_code = 'NATION_0'").withColumn("temperature_2m", F.col("temperature_2m") + 1.0), path, parts)
    back = s.read.schema(hours.schema).parquet(path)
    # stored, so that Spark knows its size, broadcasts it and skips the partitions of other regions
    dense = store(density(s, d)).where("population_density > 100").select("nuts2_code", "population_density", "urban_rural_class")
    return region.with_static(back.where("month = 202401"), dense)


def weather_written(s, d):
    """Rows, nulls and time range of the weather, measured while it is written."""
    return sinks.overwrite_measured(i.weather(s, d), f"{_own_folder(s)}/weather", "datetime_local")


def profile_rows(s, d):
    return profile.profile_rows(profile.daily_arrays(_community(s, d), CC, fill=0.0))


def profile_matrix(s, d):
    slots = materialize(_community(s, d))
    labels = encode.label_codes(slots, "community_code", "community_idx")
    out = profile.profile_matrix(slots, profile.median_baseline(slots), fd.merge_feeds(i.feeds(s, d)), labels)
    out = profile.to_wide(profile.to_wide(out, "hist", prefix="hist_"), "profile")
    rest = [c for c in out.columns if c != "feeds"]
    feeds = [F.col("feeds")[n].alias(f"{n // 3}_{'dpw'[n % 3]}") for n in range(288)]
    return out.select(*rest, *feeds)


def feeds_for_days(s, d):
    """Feeds of two known and two unknown days, in long form."""
    merged = materialize(fd.merge_feeds(i.feeds(s, d)))
    days = grid.day_spine(s, "2024-01-29", "2024-02-01")
    train = ru.rollup(i.meter(s, d), "day", CC, decimals=D).where("date < '2024-01-24'")
    out = profile.feeds_for_days(days, merged, train)
    return out.select("date", F.posexplode("feeds").alias("pos", "v")).withColumn("v", F.round("v", 4))


def all_grains(s, d):
    """The five rollups from one 15-minute frame, stacked."""
    frames = ru.all_grains(materialize(_community(s, d)), CC, decimals=D)
    parts = [
        df.select(F.lit(g).alias("grain"), "community_code", F.col(ru.GRAIN_COLUMN[g]).cast("timestamp_ntz").alias("bucket"), "total_active_kw")
        for g, df in frames.items()
    ]
    return readers.stack(parts)


def gbt_forecast(s, d):
    return fc.forecast(i.meter(s, d), START, END, "gbt", **_exogenous(s, d), decimals=D)


def ensemble_forecast(s, d):
    return fc.forecast(i.meter(s, d), START, END, "gbt", **_exogenous(s, d), settings=boosting.SCORED, seeds=[42, 43, 44], decimals=D)


def gbt_recursive(s, d):
    """Ten days, each predicted on the days predicted before."""
    return fc.forecast(i.meter(s, d), "2024-01-21 00:00:00", END, "gbt_recursive", **_exogenous(s, d), decimals=D)


def gbt_importance(s, d):
    train = materialize(ft.training_rows(matrix(s, d), START))
    return boosting.importance(boosting.fit_boosting(train))


def _candidates(s, d, carried=False):
    """The candidates; `carried` makes 15-minute feeds of the hourly ones."""
    names = dict(zip(("demand_fc", "pv_fc", "wind_fc"), ft.FEEDS, strict=True))
    feeds = {names[k]: v for k, v in i.feeds(s, d).items() if k != "demand_fc"}
    if carried:
        slots = materialize(fd.feeds_slots(feeds))
        feeds = {n: slots.select(F.col("datetime_15min").alias("datetime_local"), F.col(n).alias("value")).dropna() for n in feeds}
    stations = wx.clean_stations(i.stations(s, d))
    return ft.candidate_matrix(_total(s, d, ft.TARGET), i.weather(s, d), stations, region.degree_hours(i.weather(s, d)), feeds, decimals=D)


def candidate_matrix(s, d):
    out = _candidates(s, d)
    return out.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("hour_sin", "hour_cos")})


def ols_selection(s, d):
    # 15-minute feeds, so that all slots take part
    rows = _candidates(s, d, carried=True)
    wanted = [c for c in rows.columns if c not in ("datetime_15min", ft.TARGET)]
    return linear.ols_selection(rows, wanted, ft.TARGET)


def ols_selected(s, d):
    """What the selection decides, without the p-values themselves."""
    return ols_selection(s, d).select("feature", F.round("coefficient", 4).alias("coefficient"), "significance", "selected")


def kept_codes(s, d):
    return region.keep_codes(i.meter(s, d), "community_code", ["click", "view"], {"client_id": "7", "not_there": "x"})


def time_split(s, d):
    train, test = sampling.time_split(_total(s, d), "datetime_15min", START)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def calendar_full(s, d):
    """The calendar of all regions under the standing rules, for every year of the orders."""
    return cal.calendar_features(_years(s, d), dimensions.SPAIN_RULES, dimensions.CALENDAR_REGIONS)


def view_query(s, d):
    """A rollup registered as a view and queried by SQL."""
    (name,) = sinks.register_views({"day": ru.rollup(i.meter(s, d), "day", CC, decimals=D)})
    return s.sql("select community_code, count(*) as days, max(total_active_kw) as highest from identifier(:view) group by community_code", args={"view": name})


def _next_day_rows(s, d):
    base = ru.multigrain(i.meter(s, d), decimals=D)
    return lags.next_day_target(base)


NEXT_DAY = ["community_code_label", "day_of_week", "hour_of_day", "quarter_of_hour"]


def next_day_ols(s, d):
    train, _ = sampling.random_split(_next_day_rows(s, d), ["community_code", "datetime_15min"], 0.8)
    return linear.fit_ols(train, NEXT_DAY, "target")


def next_day_ols_coefficients(s, d):
    train, _ = sampling.random_split(_next_day_rows(s, d), ["community_code", "datetime_15min"], 0.8, portable=True)
    out = linear.fit_ols(train, NEXT_DAY, "target")
    return out.select("feature", F.round("coefficient", 5).alias("coefficient"), "n")


def _scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """MAE and R2 of the training and the test part."""
    parts = [p.select(F.lit(n).alias("part"), F.col("target").alias("actual"), "prediction") for n, p in (("train", train), ("test", test))]
    error = readers.stack(parts).withColumn("error", F.col("prediction") - F.col("actual"))
    return ev.accuracy(error, E, "part")


def next_day_ols_scores(s, d):
    rows = materialize(_next_day_rows(s, d))
    train, test = sampling.random_split(rows, ["community_code", "datetime_15min"], 0.8)
    model = linear.fit_ols(train, NEXT_DAY, "target")
    return _scores(*(linear.predict_ols(model, p, NEXT_DAY) for p in (train, test)))


def next_day_boosting(s, d):
    """Boosted trees on the next-day target with two features."""
    feats = ["community_code_label", "quarter_of_hour"]
    rows = materialize(_next_day_rows(s, d).dropna(subset=[*feats, "target"]))
    train, test = sampling.random_split(rows, ["community_code", "datetime_15min"], 0.9)
    model = boosting.fit_boosting(train, feats, "target", boosting.LEAF_31)
    return _scores(*(boosting.predict_boosting(model, p, feats, ("target",)) for p in (train, test)))


def _lag_matrix(s, d):
    names = dict(zip(("demand_fc", "pv_fc", "wind_fc"), ft.FEEDS, strict=True))
    return ft.lag_matrix(_total(s, d, ft.TARGET), {names[k]: v for k, v in i.feeds(s, d).items()}, D)


def lag_matrix(s, d):
    return _lag_matrix(s, d).withColumn("rolling_std_7d", F.round("rolling_std_7d", 6))


def lag_boosting(s, d):
    """Boosted trees on the lag matrix, split by time."""
    rows = materialize(_lag_matrix(s, d))
    train, test = sampling.time_split(rows.withColumn("target", F.col(ft.TARGET)), "datetime_15min", START)
    model = boosting.fit_boosting(train, ft.LAG_FEATURES, "target", boosting.LEAF_63)
    return _scores(*(boosting.predict_boosting(model, p, ft.LAG_FEATURES, ("target",)) for p in (train, test)))


def community_grid(s, d):
    keys = readers.distinct_codes(i.meter(s, d))
    return grid.keyed_slot_grid(keys, START, END)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "total_15min": _plain("15min", []),
    "community_15min": _plain("15min", CC),
    "client_15min": _plain("15min", ["client_id", "community_code"]),
    "community_hour": _plain("hour", CC),
    "community_day": _plain("day", CC),
    "community_week": _plain("week", CC),
    "community_month": _plain("month", CC),
    "all_grains": all_grains,
    "daily_names": lambda s, d: ru.daily_with_name(i.meter(s, d), decimals=D),
    "weekday_totals": lambda s, d: ru.weekday_totals(i.meter(s, d), decimals=D),
    "weekday_pivot": lambda s, d: ru.weekday_pivot(i.meter(s, d), decimals=D),
    "month_pivot": month_pivot,
    "multigrain_features": lambda s, d: ru.multigrain(i.meter(s, d), decimals=D),
    "time_parts": time_parts,
    "cyclic_features": cyclic_features,
    "daily_profile": daily_profile,
    "client_daily_profile": client_daily_profile,
    "community_daily_profile": community_daily_profile,
    "feed_profile": feed_profile,
    "daily_conditions": daily_conditions,
    "client_conditions": client_conditions,
    "client_conditioned_profiles": client_conditioned_profiles,
    "day_conditioned_profiles": day_conditioned_profiles,
    "client_scaled_profiles": client_scaled_profiles,
    "baseline_scaled": baseline_scaled,
    "condition_one_hot": condition_one_hot,
    "median_baseline": median_baseline,
    "median_baseline_exact": median_baseline_exact,
    "baseline_on_slots": baseline_on_slots,
    "weekday_lag_profiles": weekday_lag_profiles,
    "clock_lags": clock_lags,
    "row_lags": row_lags,
    "next_day_target": next_day_target,
    "rolling_prev7d": rolling_prev7d,
    "rolling_safe": rolling_safe,
    "lagged_demand": lagged_demand,
    "lagged_demand_10d": lagged_demand_10d,
    "upsample_carry": upsample_carry,
    "feed_slots": feed_slots,
    "feeds_outer": feeds_outer,
    "feed_join": feed_join,
    "spatial_mean": spatial_mean,
    "calendar_features": calendar_features,
    "calendar_full": calendar_full,
    "holiday_breakdown": holiday_breakdown,
    "degree_hours": degree_hours,
    "degree_hours_null_as_zero": degree_hours_null_as_zero,
    "degree_daily_mean": degree_daily_mean,
    "degree_index": _degree_index,
    "degree_monthly": degree_monthly,
    "region_month_pattern": region_month_pattern,
    "degree_summary": degree_summary,
    "region_temporal": region_temporal,
    "missing_codes": missing_codes,
    "regions_without_data": regions_without_data,
    "latest_year": latest_year,
    "sector_shares": sector_shares,
    "density": density,
    "density_class_counts": density_class_counts,
    "tourism": tourism,
    "gdp_per_capita": gdp_per_capita,
    "gdp_extremes": gdp_extremes,
    "region_static": region_static,
    "temporal_with_static": temporal_with_static,
    "weather_clean": weather_clean,
    "station_daily_mean": station_daily_mean,
    "hourly_flatten": hourly_flatten,
    "hourly_from_json": hourly_from_json,
    "stations_from_json": stations_from_json,
    "statistics_from_csv": statistics_from_csv,
    "null_report": null_report,
    "group_scale_roundtrip": lambda s, d: _roundtrip(s, d, False),
    "log_scale_roundtrip": lambda s, d: _roundtrip(s, d, True),
    "scaled_columns": scaled_columns,
    "imputed_features": imputed_features,
    "label_ids": label_ids,
    "hashed_label_ids": hashed_label_ids,
    "community_labels": community_labels,
    "label_cardinality": label_cardinality,
    "community_codes": community_codes,
    "client_sample": client_sample,
    "row_sample": row_sample,
    "rows_at_most": rows_at_most,
    "random_split": random_split,
    "feature_matrix": feature_matrix,
    "naive_forecast": naive_forecast,
    "naive_long_horizon": naive_long_horizon,
    "naive_week_ago": naive_week_ago,
    "naive_no_history": naive_no_history,
    "median_no_history": median_no_history,
    "median_forecast": median_forecast,
    "holdout_mae": holdout_mae,
    "holdout_mae_median": holdout_mae_median,
    "accuracy": accuracy,
    "bias_summary": bias_summary,
    "error_by_hour": error_by_hour,
    "error_by_weekday": error_by_weekday,
    "daily_error": daily_error,
    "daily_error_summary": daily_error_summary,
    "weekly_drift": weekly_drift,
    "verdict": verdict,
    "profile_table": profile_table,
    "meter_overview": meter_overview,
    "describe": describe,
    "table_head": table_head,
    "density_ranked": density_ranked,
    "submission": submission,
    "submission_written": submission_written,
    "grains_written": grains_written,
    "temporal_partitions": temporal_partitions,
    "weather_written": weather_written,
    "profile_rows": profile_rows,
    "profile_matrix": profile_matrix,
    "feeds_for_days": feeds_for_days,
    "gbt_forecast": gbt_forecast,
    "ensemble_forecast": ensemble_forecast,
    "gbt_recursive": gbt_recursive,
    "gbt_importance": gbt_importance,
    "candidate_matrix": candidate_matrix,
    "kept_codes": kept_codes,
    "time_split": time_split,
    "view_query": view_query,
    "ols_selection": ols_selection,
    "ols_selected": ols_selected,
    "next_day_ols": next_day_ols,
    "next_day_ols_coefficients": next_day_ols_coefficients,
    "next_day_ols_scores": next_day_ols_scores,
    "lag_matrix": lag_matrix,
    "lag_boosting": lag_boosting,
    "community_grid": community_grid,
    "next_day_boosting": next_day_boosting,
}
