"""Day-ahead feeds (demand, solar, wind): merge, de-duplicate, join to a time axis."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from .grid import carry, dedupe


def merge_feeds(feeds: Mapping[str, DataFrame], ts: str = "datetime_local", value: str = "value") -> DataFrame:
    """Full-outer merge of feeds on their timestamp, one column per feed.

    A tagged union and one grouping do in one shuffle what a chain of outer
    joins does in several.  A stamp that a feed repeats keeps its smallest
    value, so duplicates cannot multiply rows.
    """
    parts = None
    for name, df in feeds.items():
        part = df.select(ts, F.lit(name).alias("__feed"), F.col(value).cast("double").alias("__v"))
        parts = part if parts is None else parts.unionByName(part)
    cols = [F.min(F.when(F.col("__feed") == name, F.col("__v"))).alias(name) for name in feeds]
    return parts.groupBy(ts).agg(*cols)


def feed_slots(df: DataFrame, out: str, ts: str = "datetime_local", value: str = "value") -> DataFrame:
    """One feed as a 15-minute series: first row per stamp, then carried forward."""
    first = dedupe(df.select(F.col(ts).alias("__ts"), F.col(value).cast("double").alias(out)), "__ts", [out])
    return carry(first, "__ts", [out])


def feeds_slots(feeds: Mapping[str, DataFrame], ts: str = "datetime_local", value: str = "value") -> DataFrame:
    """All feeds as 15-minute series side by side, each carried over its own stamps.

    The feeds travel together as one tagged series, so their number adds no
    shuffles and no joins.
    """
    tagged = None
    for name, df in feeds.items():
        part = df.select(F.lit(name).alias("__feed"), F.col(ts).alias("__at"), F.col(value).cast("double").alias("__v"))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = dedupe(tagged, ["__feed", "__at"], ["__v"])
    slots = carry(first, "__at", ["__v"], keys=["__feed"])
    cols = [F.max(F.when(F.col("__feed") == name, F.col("__v"))).alias(name) for name in feeds]
    return slots.groupBy("datetime_15min").agg(*cols)


def join_feeds(axis: DataFrame, feeds: Mapping[str, DataFrame], ts: str = "datetime_15min", source_ts: str = "datetime_local", value: str = "value") -> DataFrame:
    """Left join of the merged feeds on the exact stamp (no carrying).

    The axis may be as large as clients x slots and the merged feeds hold a row per
    stamp; Spark broadcasts them at run time if their size in bytes allows.
    """
    merged = merge_feeds(feeds, source_ts, value).withColumnRenamed(source_ts, ts)
    return axis.join(merged, ts, "left")
