"""Standard scaling in long form, per entity and slot, and its inverse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import fixed, log_scale, mean, unlog_scale
from .profile import to_long


def _divisor(sd: Column) -> Column:
    """Population deviation, or 1 where it is zero."""
    return F.when(sd == 0.0, F.lit(1.0)).otherwise(sd)


def _moments(x: Column, decimals: int | None) -> tuple[Column, Column]:
    """Mean and population deviation; from exact sums of whole units if `decimals` is given, so in any order of the rows."""
    if decimals is None:
        return F.avg(x), F.stddev_pop(x)
    units = F.rint(x * F.lit(10.0**decimals)).cast("decimal(19,0)")
    n = F.count(x).cast("decimal(19,0)")
    # n * sum of squares - square of the sum is exact and never negative
    spread = (n * F.sum(units * units) - F.sum(units) * F.sum(units)).cast("double")
    deviation = F.sqrt(spread) / F.count(x).cast("double") / F.lit(10.0**decimals)
    return mean(x, decimals), F.when(F.count(x) > 0, deviation)


def fit_columns(df: DataFrame, columns: Sequence[str], decimals: int | None = None) -> DataFrame:
    """One row with mean and population deviation of each column."""
    aggs = []
    for c in columns:
        mu, sd = _moments(F.col(c), decimals)
        aggs += [mu.alias(f"mu_{c}"), sd.alias(f"sd_{c}")]
    return df.agg(*aggs)


def scale_columns(df: DataFrame, train: DataFrame, columns: Sequence[str], suffix: str = "_scaled", decimals: int | None = None) -> DataFrame:
    """(x - mean) / deviation, with statistics from the training rows only."""
    stats = fit_columns(train, columns, decimals)
    row = stats.select(F.struct(*stats.columns)).scalar()
    out = {
        f"{c}{suffix}": (F.col(c) - row.getField(f"mu_{c}")) / _divisor(row.getField(f"sd_{c}")) for c in columns
    }
    return df.withColumns(out)


def fit_groups(train: DataFrame, keys: Sequence[str], value: str, log: bool = False, decimals: int | None = None, profile: str | None = None) -> DataFrame:
    """Mean and deviation per group, e.g. per (entity, slot).

    With `profile`, the rows are still days with an array of that name, whose places are the last key. The result is
    packed as well, for `scale_groups` with the same `profile`.
    """
    if profile is not None:
        return _fit_profiles(train, keys[:-1], decimals, profile, log)
    x = log_scale(F.col(value)) if log else F.col(value)
    mu, sd = _moments(x, decimals)
    return train.groupBy(*keys).agg(mu.alias("mu"), sd.alias("sd"))


def _fit_profiles(train: DataFrame, keys: Sequence[str], decimals: int | None, profile: str, log: bool) -> DataFrame:
    """A row per `keys` with `stats`, a map from slot to mean and deviation.

    Only values other than zero become rows; zeros are counted as the days that are left. A slot that is not in
    the map had zeros on all days. Rows that come partitioned by `keys` are not shuffled.
    """
    if decimals is None:
        raise ValueError("days as arrays are fitted by exact sums: give `decimals`")
    # the day itself stands at slot -1
    entries = F.filter(F.transform(profile, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"].isNull() | (e["v"] != 0.0))
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("double").alias("v")))
    rows = train.select(*keys, F.explode(F.concat(whole, entries)).alias("e")).select(*keys, F.col("e.i").alias("i"), F.col("e.v").alias("v"))
    x = log_scale(F.col("v")) if log else F.col("v")
    units = F.rint(x * F.lit(10.0**decimals)).cast("decimal(19,0)")
    sums = {"rows": F.count(F.lit(1)), "nulls": F.count_if(F.col("v").isNull()), "s": F.sum(fixed(x, decimals)), "s1": F.sum(units), "s2": F.sum(units * units)}
    slots = rows.groupBy(*keys, "i").agg(*[v.alias(n) for n, v in sums.items()])
    days = F.max(F.when(F.col("i") < 0, F.col("rows")))
    own = slots.groupBy(*keys).agg(days.alias("days"), F.collect_list(F.when(F.col("i") >= 0, F.struct("i", *sums))).alias("l"))

    def stat(e: Column) -> Column:
        n = F.col("days") - e["nulls"]
        mu = F.try_divide(F.coalesce(e["s"], F.lit(0)).cast("double") / F.lit(10.0**decimals), n.cast("double"))
        s1, s2 = (F.coalesce(e[c], F.lit(0).cast("decimal(29,0)" if c == "s1" else "decimal(38,0)")) for c in ("s1", "s2"))
        spread = (n.cast("decimal(19,0)") * s2 - s1 * s1).cast("double")
        sd = F.try_divide(F.sqrt(spread), n.cast("double")) / F.lit(10.0**decimals)
        return F.struct(e["i"].alias("i"), F.struct(mu.alias("mu"), sd.alias("sd")).alias("v"))

    return own.select(*keys, F.map_from_entries(F.transform("l", stat)).alias("stats"))


def scale_groups(df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str, out: str = "scaled", log: bool = False, profile: str | None = None) -> DataFrame:
    """Scale each row with its group's statistics; a group never trained on gets 0.

    With `profile`, `df` still has days with an array of that name, and becomes one row per slot here, with the last key
    and `value`. The days are joined as they are, so that no row of a slot is shuffled or held; by hash, since
    sorting would hold every day's array.
    """
    x = log_scale(F.col(value)) if log else F.col(value)
    if profile is None:
        joined = df.join(stats, list(keys), "left")
    else:
        slot, own = keys[-1], F.col("stats")[F.col(keys[-1])]
        long = to_long(df.join(stats.hint("shuffle_hash"), list(keys[:-1]), "left"), profile, value).withColumnRenamed("interval_idx", slot)
        # a slot outside the map had zeros only
        zeros = F.when(F.col("stats").isNotNull() & own.isNull(), F.lit(0.0))
        joined = long.withColumns({"mu": F.coalesce(zeros, own["mu"]), "sd": F.coalesce(zeros, own["sd"])}).drop("stats")
        joined = joined.select(*keys, *[c for c in joined.columns if c not in keys])
    scaled = F.when(F.col("mu").isNull(), F.lit(0.0)).otherwise((x - F.col("mu")) / _divisor(F.col("sd")))
    return joined.withColumn(out, scaled).drop("mu", "sd")


def unscale_groups(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str = "scaled", out: str = "restored", log: bool = False
) -> DataFrame:
    """Inverse of `scale_groups`; a group never trained on keeps its value."""
    joined = df.join(stats, list(keys), "left")
    x = F.coalesce(F.col(value) * _divisor(F.col("sd")) + F.col("mu"), F.col(value))
    return joined.withColumn(out, unlog_scale(x) if log else x).drop("mu", "sd")
