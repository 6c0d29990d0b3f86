"""Writers: overwriting tables, bucketed and partitioned ones, measures taken while writing, submissions and named views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, functions as F


def overwrite(df: DataFrame, target: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a parquet path or a catalog table, schema included.

    Before a partitioned write the rows are rebalanced by the partition columns:
    small partitions share a task, and a hot one is split over several files.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in target:
        writer.save(target)
    else:
        writer.saveAsTable(target)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Replace a catalog table by the rows, bucketed and sorted by the keys, and return it.

    Tables of the same keys and number of buckets join on the keys without a shuffle. The rows are dealt by the keys first, so each task
    writes one file of its own bucket. `path` makes it an external table there.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions that the rows belong to, and no others; without any, the table begins with them."""
    writer = df.hint("rebalance", *partition_by).write.mode("overwrite").format("parquet")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).save(path)


def overwrite_measured(df: DataFrame, target: str, time: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Overwrite, and measure the rows as they pass: (column_name, row_count, null_count, min_time, max_time).

    The measures come out of the write's own job; the rows are read once. One value for each column reaches the driver.
    """
    seen = Observation()
    nulls = {f"{n}": F.count_if(F.col(c).isNull()).alias(f"nulls_{n}") for n, c in enumerate(df.columns)}
    stamps = [f(F.col(time).cast("timestamp_ntz")).cast("string").alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
    overwrite(df.observe(seen, F.count(F.lit(1)).alias("rows"), *stamps, *nulls.values()), target, partition_by)
    got = seen.get
    rows = [(c, got["rows"], got[f"nulls_{n}"], got["first"], got["last"]) for n, c in enumerate(df.columns)]
    table = df.sparkSession.createDataFrame(rows, "column_name string, row_count bigint, null_count bigint, min_time string, max_time string")
    return table.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("min_time", "max_time")})


def submission(predictions: DataFrame, team: str) -> DataFrame:
    """Predictions with the team name and the time of writing."""
    return predictions.withColumns({"team_name": F.lit(team), "submitted_at": F.current_timestamp()}).select(
        "team_name", "datetime_15min", "prediction", "submitted_at"
    )


def write_submission(predictions: DataFrame, team: str, target: str) -> None:
    overwrite(submission(predictions, team), target)


def register_views(frames: Mapping[str, DataFrame], prefix: str = "consumption_", suffix: str = "_per_province") -> list[str]:
    """Register rollups as temp views, e.g. consumption_hour_per_province."""
    names = []
    for grain, df in frames.items():
        name = f"{prefix}{grain}{suffix}"
        df.createOrReplaceTempView(name)
        names.append(name)
    return names
