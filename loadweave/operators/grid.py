"""Time axes, carrying values forward, and de-duplication by timestamp."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import timeparts as t


def _stamp(text: str) -> datetime:
    return datetime.fromisoformat(text)


def slot_grid(spark: SparkSession, start: str, end: str, minutes: int = t.SLOT_MINUTES, out: str = "datetime_15min") -> DataFrame:
    """Every bucket start in [start, end)."""
    step = timedelta(minutes=minutes)
    n = max(0, -((_stamp(start) - _stamp(end)) // step))
    stamp = t.ntz(start) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * minutes).cast("int"), F.lit(0))
    return spark.range(n).select(stamp.alias(out))


def day_spine(spark: SparkSession, start: str, end: str, out: str = "date") -> DataFrame:
    """Every day in [start, end]."""
    n = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    return spark.range(max(0, n)).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias(out))


def keyed_slot_grid(keys: DataFrame, start: str, end: str, out: str = "datetime_15min") -> DataFrame:
    """Every (key, slot) in [start, end): days first, then the 96 slots of each day.

    `keys` holds one row per series; no join is needed to multiply it out.
    """
    last = _stamp(end) - timedelta(minutes=t.SLOT_MINUTES)
    if last < _stamp(start):
        return keys.select("*", t.ntz(start).alias(out)).where(F.lit(False))
    days = F.sequence(F.lit(t.stamp_text(start)[:10]).cast("date"), F.lit(last.date().isoformat()).cast("date"))
    by_day = keys.withColumn("__day", F.explode(days))
    slots = F.explode(F.sequence(F.lit(0), F.lit(t.SLOTS_PER_DAY - 1)))
    stamp = F.col("__day").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.col("__slot") * t.SLOT_MINUTES, F.lit(0)
    )
    grid = by_day.withColumn("__slot", slots).withColumn(out, stamp).drop("__day", "__slot")
    return grid.where(t.in_period(out, start, end))


def dedupe(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by `order`, nulls last.

    Written as an aggregate, so that copies of a heavily repeated timestamp
    are merged before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    tail = [c for c in rest if c not in order]
    rank = []
    for c in [*order, *tail]:
        rank += [F.col(c).isNull(), F.col(c)]
    best = F.min(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("__best")
    pos = {c: f"r{2 * i + 1}" for i, c in enumerate([*order, *tail])}
    out = df.groupBy(*keys).agg(best)
    return out.select(*[F.col(c) if c in keys else F.col(f"__best.{pos[c]}").alias(c) for c in df.columns])


def carry(
    df: DataFrame,
    ts: str,
    values: Sequence[str],
    out: str = "datetime_15min",
    minutes: int = t.SLOT_MINUTES,
    carry_nulls: bool = True,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Up-sample a series with unique stamps to slots that divide an hour: each slot takes the latest source row at or before it.

    Slots run from the first to the last source stamp and no further.  With
    `carry_nulls` a source row whose value is null stays null over its slots;
    without, rows that hold only nulls are passed over.  With `keys` every key
    is a series of its own.

    The following stamp is looked up inside each day; only the first stamp of
    every day goes through a window that spans days.  A series of any length
    therefore never sits in one task.
    """
    names = [f"`{v}`" for v in values]
    by = "".join(f"`{k}`, " for k in keys)
    known = " and ".join(["__day is not null", *[f"`{k}` is not null" for k in keys]])
    src = df.selectExpr(*[f"`{k}`" for k in keys], f"`{ts}` as __ts", f"to_date(`{ts}`) as __day", *names).where(known)
    if not carry_nulls:
        src = src.dropna(how="all", subset=list(values))
    # the values are counted so that both branches share one upstream shuffle
    texts = ", ".join(f"cast({n} as string)" for n in names)
    firsts = src.groupBy(*keys, "__day").agg(F.min("__ts").alias("__first"), F.expr(f"count(coalesce({texts}))").alias("__n"))
    over_days = f"partition by {by[:-2]} order by __day" if keys else "order by __day"
    next_first = f"lead(__first) over ({over_days}) as __next_first"
    firsts = firsts.where("__n >= 0").selectExpr(*[f"`{k}`" for k in keys], "__day", next_first)
    in_day = f"lead(__ts) over (partition by {by}__day order by __ts) as __in_day"
    src = src.selectExpr("*", in_day).join(firsts, [*keys, "__day"]).withColumn("__next", F.expr("coalesce(__in_day, __next_first)"))

    step = f"interval '{minutes}' minute"

    def floor(x: str) -> str:
        return f"({x} - make_dt_interval(0, 0, minute({x}) % {minutes}, extract(second from {x})))"

    first = f"case when {floor('__ts')} = __ts then __ts else {floor('__ts')} + {step} end"
    before_next = f"case when {floor('__next')} = __next then __next - {step} else {floor('__next')} end"
    last = f"case when __next is null then {floor('__ts')} else {before_next} end"
    kept = [*[f"`{k}`" for k in keys], *names]
    spans = src.selectExpr(f"{first} as __from", f"{last} as __to", *kept).where("__from <= __to")
    return spans.selectExpr(f"explode(sequence(__from, __to, {step})) as `{out}`", *kept)
