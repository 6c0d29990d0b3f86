"""Readers for readings, feeds, weather and statistics files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import schemas as S
from .dimensions import STATIONS


def read_table(spark: SparkSession, source: str, schema=None) -> DataFrame:
    """A parquet path or a catalog table; checked against `schema` if given."""
    is_path = "/" in source or source.endswith(".parquet")
    df = spark.read.parquet(source) if is_path else spark.table(source)
    return df if schema is None else S.require(df, schema)


def read_meter(spark: SparkSession, source: str) -> DataFrame:
    return read_table(spark, source, S.METER)


def query(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """A SELECT over frames, named in braces in the text."""
    return spark.sql(text, **frames)


def read_stations(
    spark: SparkSession, path: str, stations: Mapping[str, tuple[str, str]] = STATIONS, multiline: bool = True
) -> DataFrame:
    """Landed daily station records (JSON, all text), tagged with their community.

    A record of an unlisted station keeps a null community.
    """
    return tag_stations(spark.read.schema(S.STATION).option("multiLine", multiline).json(path), stations)


def parse_stations(texts: DataFrame, column: str, stations: Mapping[str, tuple[str, str]] = STATIONS) -> DataFrame:
    """The same records from a text column, a JSON record per row; a text that is none gives a row of nulls."""
    raw = texts.select(F.from_json(column, S.STATION).alias("__r")).select("__r.*")
    return tag_stations(raw, stations)


def tag_stations(raw: DataFrame, stations: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Each record with the community of its station, by a literal table."""
    spark = raw.sparkSession
    table = spark.createDataFrame([(s, c) for c, (s, _) in stations.items()], "indicativo string, community_code string")
    return raw.join(F.broadcast(table), "indicativo", "left")


def read_hourly_documents(spark: SparkSession, path: str, variables: Sequence[str] = S.HOURLY_VARIABLES, multiline: bool = True) -> DataFrame:
    """Landed hourly-weather documents (JSON with parallel arrays)."""
    return spark.read.schema(S.hourly_document(variables)).option("multiLine", multiline).json(path)


def parse_hourly_documents(texts: DataFrame, column: str, variables: Sequence[str] = S.HOURLY_VARIABLES) -> DataFrame:
    """The same documents from a text column, one per row."""
    return texts.select(F.from_json(column, S.hourly_document(variables)).alias("__r")).select("__r.*")


def parse_statistics(texts: DataFrame, column: str, dims: Sequence[str], years: Sequence[int | str], sep: str = ",") -> DataFrame:
    """A wide statistics table from a text column, a line per row without a header."""
    schema = ", ".join(f"`{f.name}` string" for f in S.statistics_table(dims, years).fields)
    return texts.select(F.from_csv(column, schema, {"sep": sep}).alias("__r")).select("__r.*")


def read_statistics(spark: SparkSession, path: str, dims: Sequence[str], years: Sequence[int | str], sep: str = ",") -> DataFrame:
    """A wide statistics file: dimensions and one column per year, all as text."""
    return spark.read.schema(S.statistics_table(dims, years)).option("header", True).option("sep", sep).csv(path)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames over the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_codes(df: DataFrame, key: str = "community_code") -> DataFrame:
    return df.select(key).distinct()
