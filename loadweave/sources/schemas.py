"""Explicit schemas; nothing is inferred at read time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, d) for n, d in fields])


METER = _struct(
    ("client_id", T.LongType()),
    ("datetime_local", T.TimestampNTZType()),
    ("community_code", T.StringType()),
    ("active_kw", T.DoubleType()),
)

FEED = _struct(("datetime_local", T.TimestampNTZType()), ("value", T.DoubleType()))

PREDICTION = _struct(("datetime_15min", T.TimestampNTZType()), ("prediction", T.DoubleType()))

# fixed values: station columns that stay text
STATION_TEXT_COLUMNS = (
    "fecha",
    "community_code",
    "indicativo",
    "nombre",
    "provincia",
    "altitud",
    "horatmin",
    "horatmax",
    "horaracha",
    "horaPresMax",
    "horaPresMin",
    "horaHrMax",
    "horaHrMin",
    "dir",
)

# fixed values: station measures
STATION_MEASURES = (
    "tmed", "prec", "tmin", "tmax", "velmedia", "racha", "sol", "presMax", "presMin", "hrMedia", "hrMax", "hrMin",
)

STATION = _struct(*[(c, T.StringType()) for c in STATION_TEXT_COLUMNS + STATION_MEASURES if c != "community_code"])

# fixed values: hourly weather variables
HOURLY_VARIABLES = (
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "apparent_temperature",
    "precipitation",
    "rain",
    "snowfall",
    "snow_depth",
    "weather_code",
    "pressure_msl",
    "surface_pressure",
    "cloud_cover",
    "cloud_cover_low",
    "cloud_cover_mid",
    "cloud_cover_high",
    "wind_speed_10m",
    "wind_speed_100m",
    "wind_direction_10m",
    "wind_direction_100m",
    "wind_gusts_10m",
    "et0_fao_evapotranspiration",
    "vapour_pressure_deficit",
    "soil_temperature_0cm",
    "soil_temperature_6cm",
    "soil_temperature_18cm",
    "soil_temperature_54cm",
    "soil_moisture_0_to_1cm",
    "soil_moisture_1_to_3cm",
    "soil_moisture_3_to_9cm",
    "soil_moisture_9_to_27cm",
    "soil_moisture_27_to_81cm",
    "shortwave_radiation",
    "direct_radiation",
    "diffuse_radiation",
    "direct_normal_irradiance",
    "global_tilted_irradiance",
    "terrestrial_radiation",
    "shortwave_radiation_instant",
    "direct_radiation_instant",
    "diffuse_radiation_instant",
    "direct_normal_irradiance_instant",
    "global_tilted_irradiance_instant",
    "terrestrial_radiation_instant",
    "sunshine_duration",
    "is_day",
)


def hourly_document(variables: Sequence[str] = HOURLY_VARIABLES) -> T.StructType:
    """Schema of one landed hourly-weather document."""
    arrays = [("time", T.ArrayType(T.StringType()))] + [(v, T.ArrayType(T.DoubleType())) for v in variables]
    return _struct(
        ("community_code", T.StringType()),
        ("latitude", T.DoubleType()),
        ("longitude", T.DoubleType()),
        ("elevation", T.DoubleType()),
        ("hourly", _struct(*arrays)),
    )


def statistics_table(dims: Sequence[str], years: Sequence[int | str]) -> T.StructType:
    """Schema of a wide statistics file: text dimensions, then one text column per year."""
    return _struct(*[(c, T.StringType()) for c in [*dims, *map(str, years)]])


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Check that the columns are there and cast them to the schema's types."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
