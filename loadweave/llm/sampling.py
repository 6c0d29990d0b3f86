"""The rows that classifiers may learn from, and bounded samples of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadweave.llm.common import stored
from loadweave.operators.sampling import hash_fraction, sample_at_most

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents of fold 0, which nothing is learned from. Rows without an id are held out as well."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) == 0, F.lit(True))


def bounded_sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """At most `max_rows` of the rows (doc_id, ...), the first in the order of a hash of the id; the same on every run.

    The rows are stored and counted, so that only about as many as are wanted are ever sorted.
    """
    return stored(sample_at_most(stored(rows), max_rows, ["doc_id"]))


def sample_of_each(rows: DataFrame, group: str, max_rows: int) -> DataFrame:
    """At most `max_rows` of each group's rows (doc_id, ...), the first in the order of a hash of the id; no group is without a row.

    The rows of a group are counted, so that only about as many as are wanted of each are ever sorted.
    """
    hashed = stored(rows.withColumn("u", hash_fraction(["doc_id"])))
    slack = max_rows + 6.0 * math.sqrt(max_rows) + 10
    groups = stored(hashed.groupBy(group).agg((F.lit(slack) / F.count("*")).alias("share"), F.min("u").alias("least")))
    thin = hashed.join(F.broadcast(groups), group).where(F.col("u") <= F.greatest("share", "least"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("u", "doc_id"))
    return stored(thin.withColumn("place", place).where(F.col("place") <= max_rows).select(*rows.columns))
