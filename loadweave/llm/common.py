"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadweave.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_name(wanted: str, df: DataFrame) -> str:
    """A name that no column of the frame has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def version() -> Column:
    """Tells rows apart that share a doc_id: a hash of the text."""
    return F.xxhash64(whole())


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. Pure ASCII takes the fast built-in."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, also where `body` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def stored(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write the frame to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never the work before it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a stored, narrow frame for broadcasting if its row count is within the bound.

    Beyond the bound the frame comes back unmarked and the join shuffles. Call it on
    frames read from files only: their count comes from the file footers.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that gives its memory back at its end: Python workers stay on for other tasks and stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task


def values(column: pa.Array, step: int = 256) -> Iterator:
    """The column's Python values, a few at a time."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def side_of(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """Mark a stored, narrow frame for broadcasting if its values are within the bound, measured by one pass over them.

    Beyond the bound the frame comes back unmarked and the join shuffles.
    """
    sizes = [F.octet_length(f.name) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in df.schema]
    size = sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(16))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= max_bytes else df
