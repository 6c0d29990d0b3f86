"""Reproducible sampling and splitting by hash, independent of partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def hash_fraction(keys: Sequence[str], seed: int = 42, portable: bool = False) -> Column:
    """A value in [0, 1) that depends only on the keys and the seed.

    `portable` uses the leading 32 bits of an MD5, which other engines can
    reproduce; otherwise the faster 64-bit xxHash.
    """
    if portable:
        text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
        bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
        return bits / F.lit(2.0**32)
    bits = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(2**32).cast("long"))
    return bits / F.lit(2.0**32)


def sample_entities(df: DataFrame, key: str, fraction: float, seed: int = 42, portable: bool = False) -> DataFrame:
    """All rows of a fraction of the entities.

    The hash decides on each row alone, so there is no distinct, no join and no
    shuffle, and an entity is either whole or absent.
    """
    return df.where(hash_fraction([key], seed, portable) < fraction)


def sample_rows(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42, portable: bool = False) -> DataFrame:
    """A fraction of the rows; `keys` must identify a row."""
    return df.where(hash_fraction(keys, seed, portable) < fraction)


def sample_at_most(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42, portable: bool = False) -> DataFrame:
    """n random rows (all, if there are fewer).

    A count sets a cut-off that a little more than n rows pass, so the final
    ordering sees about n rows in all instead of n rows from every task.  The
    frame is read up to three times; materialise an expensive one first.
    """
    u = hash_fraction(keys, seed, portable)
    rows = df.count()
    if rows <= n:
        return df
    slack = n + 6.0 * math.sqrt(n) + 10
    if slack < rows:
        thin = df.where(u < slack / rows)
        if thin.count() >= n:
            df = thin
    return df.orderBy(u, *keys).limit(n)


def random_split(df: DataFrame, keys: Sequence[str], train_fraction: float, seed: int = 42, portable: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test), disjoint and complete, and the same however the frame is partitioned."""
    u = hash_fraction(keys, seed, portable)
    return df.where(u < train_fraction), df.where(u >= train_fraction)


def time_split(df: DataFrame, ts: str, cut: str) -> tuple[DataFrame, DataFrame]:
    """(before the cut, from the cut on)."""
    edge = F.lit(cut).cast("timestamp_ntz")
    return df.where(F.col(ts) < edge), df.where(F.col(ts) >= edge)
