"""Weather and station data: cleaning, flattening, averaging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import timeparts as t
from ..functions.numeric import comma_number, mean
from ..sources.schemas import STATION_TEXT_COLUMNS


def clean_stations(raw: DataFrame, text_columns: Sequence[str] = STATION_TEXT_COLUMNS, day: str = "fecha") -> DataFrame:
    """Daily station records (all text, decimal commas) to typed columns; undated rows go."""
    keep = set(text_columns)
    cols = [F.col(c) if c in keep else comma_number(F.col(c)).alias(c) for c in raw.columns]
    return raw.select(*cols).withColumn(day, t.parse_day(F.col(day))).where(F.col(day).isNotNull())


def flatten_hourly(docs: DataFrame, hourly: str = "hourly", time: str = "time", keep: Sequence[str] = ("community_code", "latitude", "longitude", "elevation")) -> DataFrame:
    """Documents with parallel hourly arrays to one row per hour.

    The arrays are zipped and inlined in the executors; unparsable stamps go.
    """
    fields = [f.name for f in docs.schema[hourly].dataType.fields]
    zipped = F.arrays_zip(*[F.col(f"{hourly}.{f}").alias(f) for f in fields])
    kept = [c for c in keep if c in docs.columns]
    rows = docs.select(*kept, F.explode(zipped).alias("__h"))
    stamp = t.parse_stamp(F.col(f"__h.{time}")).alias("datetime_local")
    values = [F.col(f"__h.{f}").alias(f) for f in fields if f != time]
    return rows.select(stamp, *kept, *values).where(F.col("datetime_local").isNotNull()).withColumn("date", F.to_date("datetime_local"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, null_count, null_pct) for every column, in one pass."""
    n = F.count(F.lit(1)).alias("__rows")
    row = df.agg(n, *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = row.unpivot("__rows", df.columns, "column_name", "null_count")
    pct = F.try_divide(F.col("null_count").cast("double"), F.col("__rows").cast("double")) * 100
    return long.select("column_name", "null_count", pct.alias("null_pct"), F.col("__rows").alias("row_count"))


def partial_null_report(df: DataFrame) -> DataFrame:
    """Columns with some, but not only, nulls."""
    report = null_counts(df).where((F.col("null_count") > 0) & (F.col("null_count") < F.col("row_count")))
    return report.drop("row_count")


def drop_empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns that hold only nulls.  One aggregate row tells which."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if c in keep or counts[c] > 0])


def spatial_mean(df: DataFrame, values: Sequence[str], ts: str = "datetime_local", decimals: int | None = None) -> DataFrame:
    """Mean over communities per stamp, nulls left out."""
    return df.groupBy(ts).agg(*[mean(F.col(c).cast("double"), decimals).alias(c) for c in values])


def daily_mean(df: DataFrame, values: Sequence[str], day: str = "date", decimals: int | None = None) -> DataFrame:
    """Mean over stations (or over all hours and regions) per date."""
    return df.groupBy(F.col(day).alias("date")).agg(*[mean(F.col(c).cast("double"), decimals).alias(c) for c in values])
