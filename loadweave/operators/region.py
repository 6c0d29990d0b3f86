"""Regional features: degree-hours, wide statistics tables, shares and indices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import clip, mean, ratio, to_number, total

HEATING_BASE = 18.0
COOLING_BASE = 22.0
URBAN_DENSITY = 1500
INTERMEDIATE_DENSITY = 300
URBAN_CLASSES = ("intermediate", "rural", "unknown", "urban")


def degree_hours(
    weather: DataFrame,
    start: str | None = None,
    end: str | None = None,
    heating: float = HEATING_BASE,
    cooling: float = COOLING_BASE,
    null_as_zero: bool = False,
    temperature: str = "temperature_2m",
) -> DataFrame:
    """Heating and cooling degrees per hour for dates in [start, end].

    A missing temperature gives missing degrees.  `null_as_zero` instead
    counts it as no heating and no cooling, as a bare GREATEST would.
    """
    df = weather if "date" in weather.columns else weather.withColumn("date", F.to_date("datetime_local"))
    if start is not None and end is not None:
        df = df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    temp = F.col(temperature)

    def above_zero(x: Column) -> Column:
        return F.greatest(F.lit(0.0), x) if null_as_zero else clip(x, low=0.0)

    return df.withColumns({"hdd_hourly": above_zero(F.lit(heating) - temp), "cdd_hourly": above_zero(temp - F.lit(cooling))})


def code_table(df: DataFrame, mapping: Mapping[str, object], key: str, value: str, dtype: str = "string") -> DataFrame:
    """A literal mapping as a small frame on the session of `df`."""
    return df.sparkSession.createDataFrame(list(mapping.items()), f"{key} string, {value} {dtype}")


def map_codes(df: DataFrame, mapping: Mapping[str, object], key: str, out: str, dtype: str = "string") -> DataFrame:
    """Look codes up in a fixed mapping; an unmapped code gives null."""
    table = code_table(df, mapping, "__code", out, dtype)
    return df.join(F.broadcast(table), F.col(key) == F.col("__code"), "left").drop("__code")


def missing_codes(df: DataFrame, mapping: Mapping[str, object], key: str) -> DataFrame:
    """Codes in the data that the mapping lacks."""
    table = code_table(df, {k: k for k in mapping}, "__code", "__v")
    found = df.select(key).where(F.col(key).isNotNull()).distinct()
    return found.join(F.broadcast(table), F.col(key) == F.col("__code"), "left_anti")


def regions_without_data(df: DataFrame, regions: Sequence[str], key: str = "nuts2_code") -> DataFrame:
    """Listed regions that the data lacks."""
    listed = df.sparkSession.createDataFrame([(r,) for r in regions], f"{key} string")
    return listed.join(df.select(key).distinct(), key, "left_anti")


def keep_codes(df: DataFrame, key: str, codes: Sequence[str], equals: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of the listed codes; each equality applies only if its column exists."""
    out = df.where(F.col(key).isin(*codes))
    for col, value in (equals or {}).items():
        if col in df.columns:
            out = out.where(F.col(col) == F.lit(value))
    return out


def latest_year_column(df: DataFrame) -> str:
    """Name of the highest four-digit column."""
    years = [c for c in df.columns if len(c) == 4 and c.isdigit()]
    if not years:
        raise ValueError("the table has no year column")
    return max(years)


def latest_year(df: DataFrame, dims: Sequence[str], out: str = "value") -> DataFrame:
    """Dimensions and the latest year's value as a number.

    The year is the highest column of the table, not the latest filled one, so
    only that column is read.
    """
    return df.select(*dims, to_number(F.col(f"`{latest_year_column(df)}`")).alias(out))


def latest_year_long(df: DataFrame, year: str = "year") -> DataFrame:
    """Rows of the highest year in a long table."""
    return df.where(F.col(year) == df.select(F.max(year)).scalar())


def density_features(population: DataFrame, area: DataFrame, key: str = "nuts2_code") -> DataFrame:
    """Inhabitants per km2 and the density class.

    `population` is (key, population); `area` is (key, area_km2[, region_name]).
    """
    joined = population.join(area, key, "left")
    density = ratio(F.col("population"), F.col("area_km2"))
    out = joined.withColumn("population_density", density)
    return out.withColumn("urban_rural_class", urban_class(F.col("population_density")))


def urban_class(density: Column) -> Column:
    return (
        F.when(density.isNull(), "unknown")
        .when(density > URBAN_DENSITY, "urban")
        .when(density > INTERMEDIATE_DENSITY, "intermediate")
        .otherwise("rural")
    )


def urban_one_hot(col: str = "urban_rural_class") -> dict[str, Column]:
    """A 0/1 column per class over the fixed class list."""
    return {f"is_{c}": F.coalesce((F.col(col) == c).cast("int"), F.lit(0)) for c in URBAN_CLASSES}


def class_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out))


def tourism_features(nights: DataFrame, population: DataFrame, key: str = "nuts2_code", decimals: int | None = None) -> DataFrame:
    """Nights per inhabitant and the destination flag (over 1.5 x the median; no ratio = 0)."""
    summed = nights.groupBy(key).agg(F.coalesce(total("nights", decimals), F.lit(0.0)).alias("tourism_nights"))
    out = summed.join(population, key, "left")
    out = out.withColumn("tourism_nights_per_capita", ratio(F.col("tourism_nights"), F.col("population")))
    median = out.select(F.percentile("tourism_nights_per_capita", 0.5)).scalar()
    flag = F.coalesce((F.col("tourism_nights_per_capita") > median * F.lit(1.5)).cast("int"), F.lit(0))
    return out.withColumn("is_holiday_destination", flag)


def sector_shares(
    gva: DataFrame,
    shares: Mapping[str, str],
    total_code: str = "TOTAL",
    key: str = "nuts2_code",
    sector: str = "nace_r2",
    value: str = "value",
) -> DataFrame:
    """Share of each listed sector in the region's total: {output name: sector code}.

    One grouping replaces a self-join per sector; regions without a total row are left out.
    """

    def of(code: str) -> Column:
        return F.max(F.when(F.col(sector) == code, F.col(value)))

    has_total = F.count_if(F.col(sector) == total_code).alias("__has")
    cols = [of(c).alias(f"__s{i}") for i, c in enumerate(shares.values())]
    wide = gva.groupBy(key).agg(of(total_code).alias("__total"), has_total, *cols).where("__has > 0")
    picked = [ratio(F.col(f"__s{i}"), F.col("__total")).alias(n) for i, n in enumerate(shares)]
    return wide.select(key, *picked)


def min_max(df: DataFrame, columns: Mapping[str, float | None]) -> DataFrame:
    """Scale columns to [0, 1] as `<name>_normalized`; {name: value when all are equal}."""
    stats = df.select(
        F.struct(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    ).scalar()
    out = {}
    for c, constant in columns.items():
        lo, hi = stats.getField(f"lo_{c}"), stats.getField(f"hi_{c}")
        scaled = F.try_divide(F.col(c) - lo, hi - lo)
        if constant is not None:
            scaled = F.when(hi > lo, scaled).otherwise(F.lit(constant))
        out[f"{c}_normalized"] = scaled
    return df.withColumns(out)


def extremes(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with the highest and the lowest value, and both values."""
    by = F.struct(F.col(value), F.col(key))
    known = df.where(F.col(value).isNotNull())
    return known.agg(
        F.max_by(key, by).alias("highest"),
        F.max(value).alias("highest_value"),
        F.min_by(key, by).alias("lowest"),
        F.min(value).alias("lowest_value"),
    )


def gdp_per_capita(gdp: DataFrame, population: DataFrame, key: str = "nuts2_code") -> DataFrame:
    """Per-inhabitant figures in the best unit the table has.

    EUR_HAB if present; else MIO_EUR x 1e6 / population; else the alphabetically
    first unit as it is.  `gdp` is (key, unit, value).
    """
    unit = F.col("unit")
    rank = F.when(unit == "EUR_HAB", 0).when(unit == "MIO_EUR", 1).otherwise(2)
    chosen = gdp.select(F.min(F.struct(rank.alias("rank"), unit.alias("unit")))).scalar()
    rows = gdp.where(unit == chosen.getField("unit")).join(population, key, "left")
    converted = ratio(F.col("value") * F.lit(1e6), F.col("population"))
    return rows.select(key, F.when(unit == "MIO_EUR", converted).otherwise(F.col("value")).alias("gdp_per_capita_eur"))


def degree_totals(hours: DataFrame, keys: Sequence[str] = ("nuts2_code",), suffix: str = "", decimals: int | None = None) -> DataFrame:
    """Degree-hour sums per region (rows with no region are left out; all-null sums are 0)."""
    known = hours.where(F.col(keys[0]).isNotNull())
    return known.groupBy(*keys).agg(
        F.coalesce(total("hdd_hourly", decimals), F.lit(0.0)).alias(f"hdd{suffix}"),
        F.coalesce(total("cdd_hourly", decimals), F.lit(0.0)).alias(f"cdd{suffix}"),
    )


def degree_totals_monthly(hours: DataFrame, decimals: int | None = None) -> DataFrame:
    dated = hours.withColumns({"year": F.year("date"), "month": F.month("date")})
    return degree_totals(dated, ["nuts2_code", "year", "month"], "_monthly", decimals)


def region_month_pattern(hours: DataFrame, decimals: int | None = None, day_decimals: int | None = None) -> DataFrame:
    """Two-stage pattern per region: daily means and sums, then per month (rounded to 0.1)."""
    known = hours.where(F.col("nuts2_code").isNotNull())
    daily = known.groupBy("nuts2_code", "date").agg(
        mean("temperature_2m", decimals).alias("avg_temp"),
        F.coalesce(total("hdd_hourly", decimals), F.lit(0.0)).alias("total_hdd"),
        F.coalesce(total("cdd_hourly", decimals), F.lit(0.0)).alias("total_cdd"),
    )
    return daily.groupBy("nuts2_code", F.month("date").alias("month")).agg(
        F.round(mean("avg_temp", day_decimals), 1).alias("avg_temp"),
        F.round(total("total_hdd", decimals), 1).alias("total_hdd"),
        F.round(total("total_cdd", decimals), 1).alias("total_cdd"),
    )


def degree_summary(hours: DataFrame, decimals: int | None = None) -> DataFrame:
    """Record, region and date span plus temperature and degree statistics."""
    return hours.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("nuts2_code").alias("regions"),
        F.countDistinct("datetime_local").alias("hours"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        mean("temperature_2m", decimals).alias("avg_temperature"),
        F.min("temperature_2m").alias("min_temperature"),
        F.max("temperature_2m").alias("max_temperature"),
        mean("hdd_hourly", decimals).alias("avg_hdd"),
        F.max("hdd_hourly").alias("max_hdd"),
        mean("cdd_hourly", decimals).alias("avg_cdd"),
        F.max("cdd_hourly").alias("max_cdd"),
    )


def temporal_features(hours: DataFrame) -> DataFrame:
    """The hourly table's six columns."""
    return hours.select("datetime_local", "date", "nuts2_code", "temperature_2m", "hdd_hourly", "cdd_hourly")


def static_features(
    density: DataFrame,
    population: DataFrame,
    tourism: DataFrame,
    gdp: DataFrame,
    shares: DataFrame,
    degrees: DataFrame,
    key: str = "nuts2_code",
) -> DataFrame:
    """One row per region: the density frame left-joined to every other feature, plus class flags."""
    out = density.select(key, "region_name", "population_density", "urban_rural_class")
    out = out.join(population.select(key, F.col("population").alias("total_population")), key, "left")
    out = out.join(tourism.select(key, "tourism_nights_per_capita", "is_holiday_destination"), key, "left")
    out = out.join(shares, key, "left").join(gdp, key, "left").join(degrees, key, "left")
    return out.withColumns(urban_one_hot())


def with_static(temporal: DataFrame, static: DataFrame, key: str = "nuts2_code") -> DataFrame:
    """Hourly rows beside their region's static features."""
    return temporal.join(static, key)
