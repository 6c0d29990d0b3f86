"""Column helpers for sums, ratios, clipping and lenient casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec


def fixed(value: Column, decimals: int) -> Column:
    """The value as a whole number of 10^-decimals units."""
    return F.rint(value * F.lit(10.0**decimals)).cast("long")


def total(value: Column | str, decimals: int | None = None, over: WindowSpec | None = None) -> Column:
    """Sum of a double column.

    Floating sums depend on the order in which partitions arrive.  When the
    source has a known number of decimals, give it: the sum then runs on
    64-bit integers (still inside generated code) and is the same on every
    run and every cluster size.
    """
    value = F.col(value) if isinstance(value, str) else value
    agg = F.sum(value if decimals is None else fixed(value, decimals))
    agg = agg if over is None else agg.over(over)
    return agg if decimals is None else agg.cast("double") / F.lit(10.0**decimals)


def mean(value: Column | str, decimals: int | None = None, over: WindowSpec | None = None) -> Column:
    """Average over the non-null values, order-independent when `decimals` is given."""
    value = F.col(value) if isinstance(value, str) else value
    if decimals is None:
        agg = F.avg(value)
        return agg if over is None else agg.over(over)
    n = F.count(value)
    n = n if over is None else n.over(over)
    return F.try_divide(total(value, decimals, over), n.cast("double"))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to [low, high]; a null stays null (bare greatest/least would drop it)."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is zero or either is null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column) -> Column:
    return ratio(num, den) * F.lit(100.0)


def to_number(value: Column) -> Column:
    """Text to double; unparsable text becomes null instead of an error."""
    return F.trim(value.cast("string")).try_cast("double")


def comma_number(value: Column) -> Column:
    """Decimal-comma text to double; words such as trace or various become null."""
    return F.trim(F.replace(value.cast("string"), F.lit(","), F.lit("."))).try_cast("double")


def log_scale(value: Column) -> Column:
    """log(1 + x) with x clipped at zero from below."""
    return F.log1p(clip(value, low=0.0))


def unlog_scale(value: Column, high: float = 30.0) -> Column:
    """exp(x) - 1 with x clipped to [0, high] so that it stays finite."""
    return F.expm1(clip(value, 0.0, high))
