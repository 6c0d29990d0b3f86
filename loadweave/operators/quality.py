"""Null handling and read-back checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import mean, total
from ..session import materialize


def medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column; for slot- or region-sized frames."""
    return train.agg(*[F.percentile(F.col(c).cast("double"), 0.5).alias(c) for c in columns])


def impute_medians(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the training rows' medians, 0 where there is none.

    The medians form one row, read through a scalar subquery: no join, and
    nothing passes through the driver.
    """
    stats = medians(train, columns)
    row = stats.select(F.struct(*stats.columns)).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), row.getField(c), F.lit(0.0)) for c in columns})


def table_profile(
    df: DataFrame,
    time: str,
    key: str | None = None,
    averages: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
    round_to: int = 1,
    decimals: int | None = None,
) -> DataFrame:
    """Row count, first and last time, rounded averages and sums, per key or over all."""
    aggs = [F.count(F.lit(1)).alias("row_count"), F.min(time).alias("min_time"), F.max(time).alias("max_time")]
    aggs += [F.round(mean(c, decimals), round_to).alias(n) for n, c in (averages or {}).items()]
    aggs += [F.round(total(c, decimals), round_to).alias(n) for n, c in (sums or {}).items()]
    return df.groupBy(*([key] if key else [])).agg(*aggs)


def meter_overview(df: DataFrame, client: str = "client_id", ts: str = "datetime_local") -> DataFrame:
    """Rows, clients and time span of the readings."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(client).alias("client_count"),
        F.min(ts).alias("min_time"),
        F.max(ts).alias("max_time"),
    )


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column_name, q0, q1, ...): exact, linearly interpolated quantiles of columns of any size.

    All columns go through one pass: equal values are counted together, the
    distinct (column, value) pairs range-partitioned and ranked inside their
    range; ranges are shifted by the rows before them.  No task holds more than
    one range.  The counts are stored once, which runs a job.
    """
    known = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]))).where("v is not null")
    counted = known.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("w"))
    # stored, so that every branch sees the same ranges
    parts = materialize(counted.repartitionByRange("column_name", "v").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("column_name", "part").agg(F.sum("w").alias("n"))
    # a row per column and range
    upto_part = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("column_name", "part", F.coalesce(F.sum("n").over(upto_part), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("column_name")).alias("n"))
    upto = F.sum("w").over(Window.partitionBy("column_name", "part").orderBy("v"))
    ranked = parts.withColumn("upto", upto).join(offsets, ["column_name", "part"]).withColumn("last", F.col("before") + F.col("upto"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("last") - F.col("w")) & (rank < F.col("last")), F.col("v")))

    found = ranked.groupBy("column_name").agg(
        *[at(F.floor((F.col("n") - 1) * F.lit(p))).alias(f"lo{i}") for i, p in enumerate(probs)],
        *[at(F.ceil((F.col("n") - 1) * F.lit(p))).alias(f"hi{i}") for i, p in enumerate(probs)],
        *[F.max((F.col("n") - 1) * F.lit(p) % 1).alias(f"part{i}") for i, p in enumerate(probs)],
    )
    mixed = [F.expr(f"lo{i} + (hi{i} - lo{i}) * part{i}").alias(f"q{i}") for i in range(len(probs))]
    return found.select("column_name", *mixed)


def describe(df: DataFrame, columns: Sequence[str], decimals: int | None = None, accuracy: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per column over all rows, one row per column.

    The quartiles are exact and interpolated, from one pass over all columns; give
    `accuracy` to take them from a sketch of that accuracy instead, in the same pass
    as the rest and without a job of their own.
    """
    rows = []
    for c in columns:
        q = F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], accuracy or 100)
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(c).alias("n"),
                mean(c, decimals).alias("mean"),
                F.stddev(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                *([q[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))] if accuracy else []),
                F.max(c).cast("double").alias("max"),
            )
        )
    out = df.agg(F.array(*rows).alias("__rows")).select(F.inline("__rows"))
    if accuracy:
        return out
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75]).withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"})
    names = ["column_name", "n", "mean", "std", "min", "p25", "p50", "p75", "max"]
    return out.join(quartiles, "column_name", "left").select(*names)


def head_rows(df: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """The first n rows in key order (a top-n per task, then of those)."""
    return df.orderBy(*keys).limit(n)


def ranked(df: DataFrame, metric: str, tie_break: str) -> DataFrame:
    """Rows in descending order of a metric, nulls last; for output only."""
    return df.orderBy(F.desc_nulls_last(metric), tie_break)
