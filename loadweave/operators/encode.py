"""Label, one-hot and index encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize


def label_codes(df: DataFrame, key: str, out: str, through: str | None = None) -> DataFrame:
    """(key, 0-based rank in key order) for a dimension key such as a region code.

    Only the distinct keys are ranked; the reading rows never meet in one task.
    For keys that grow with the data use `label_ids`.  When `df` is itself an
    aggregate that the caller goes on to use, name its measure in `through`:
    counting it keeps both branches' aggregates alike, so Spark runs and
    shuffles that aggregate once.
    """
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(through or F.lit(1)).alias("__n"))
    codes = rows.where("__n >= 0").select(key)
    return codes.withColumn(out, (F.row_number().over(Window.orderBy(key)) - 1).cast("int"))


def label_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """(key, 0-based rank in key order) for ids of any number and spread.

    The distinct ids are range-partitioned and stored, ranked inside their range
    and shifted by the number of ids in lower ranges, so no window sees more rows
    than a range has, or than there are ranges.
    """
    ids = df.select(key).distinct().where(F.col(key).isNotNull())
    # stored, so that both branches see the same ranges
    ids = materialize(ids.repartitionByRange(key).withColumn("__range", F.spark_partition_id()))
    ranked = ids.withColumn("__rank", F.row_number().over(Window.partitionBy("__range").orderBy(key)))
    sizes = ids.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    return ranked.join(offsets, "__range").select(key, (F.col("__before") + F.col("__rank") - 1).cast("int").alias(out))


def cardinality(labels: DataFrame, label: str, out: str = "n") -> DataFrame:
    """Number of labels, as highest label + 1."""
    return labels.agg((F.max(label) + 1).alias(out))


def one_hot(col: str, values: Sequence, names: Sequence[str]) -> dict[str, Column]:
    """0/1 columns over a fixed category list, so the schema never depends on the rows."""
    return {n: F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)) for v, n in zip(values, names, strict=True)}


def calendar_one_hot(dow: str = "day_of_week", month: str = "month") -> dict[str, Column]:
    cols = one_hot(dow, range(1, 8), [f"dow_{d}" for d in range(1, 8)])
    return cols | one_hot(month, range(1, 13), [f"month_{m}" for m in range(1, 13)])
