"""Boosted trees on a compact slot matrix, grown by one barrier job (`trees`)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.quality import impute_medians
from ..operators.sampling import sample_at_most
from ..session import ensure_checkpoint_dir, materialize, store
from . import trees
from .features import ALL_FEATURES, TARGET, prediction_rows, training_rows

#: Rows from whose values the bins are taken; all rows where there are fewer
BIN_ROWS = 200_000
#: Training rows of one task
TASK_ROWS = 200_000


@dataclass(frozen=True)
class BoostingSettings:
    """Trees of `depth` levels, or where `leaves` is given grown leaf by leaf to that number."""

    rounds: int = 1000
    depth: int | None = 5
    learning_rate: float = 0.05
    subsample: float = 0.8
    min_leaf: int = 10
    bins: int = 64
    seed: int = 42
    leaves: int | None = None


# fixed values: the scored settings, and leaf-wise trees of 31 and 63 leaves
SCORED = BoostingSettings()
LEAF_31 = BoostingSettings(100, None, 0.1, 1.0, 20, bins=255, seed=20, leaves=31)
LEAF_63 = BoostingSettings(500, None, 0.05, 1.0, 50, bins=255, leaves=63)


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: the stored nodes of its trees, in `trees.TREES`, and the names of its features."""

    nodes: DataFrame
    features: tuple[str, ...]


def fit_boosting(
    train: DataFrame,
    features: Sequence[str] = ALL_FEATURES,
    target: str = TARGET,
    settings: BoostingSettings = SCORED,
    seeds: Sequence[int] | None = None,
    tasks: int | None = None,
) -> BoostedTrees:
    """Fit on a stored frame without nulls; with several `seeds` one model each, in the same job.

    The model is the same for any layout of the rows and any number of tasks. The driver sees at most `BIN_ROWS`
    rows, for the bins, and the nodes of the trees.
    """
    features = list(features)
    rows = train.select(*features, target)
    n = rows.count()
    if not n:
        raise ValueError("no rows to learn from")
    sample = sample_at_most(rows.select(*[F.col(f).cast("double") for f in features]), BIN_ROWS, features).toPandas()
    cuts = [trees.edges(sample[f].to_numpy(), settings.bins) for f in features]
    folder = f"{ensure_checkpoint_dir(train.sparkSession)}/boosting"
    s = settings
    task = trees.grow(cuts, s.rounds, s.depth, s.leaves, s.learning_rate, s.subsample, s.min_leaf, list(seeds or [s.seed]), folder)
    # all tasks of a barrier job run at the same time
    tasks = tasks or min(max(2, math.ceil(n / TASK_ROWS)), rows.sparkSession.sparkContext.defaultParallelism)
    columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([target, *features])]
    dealt = rows.select(F.xxhash64(*features, target).alias("hash"), *columns).repartition(tasks, "hash")
    return BoostedTrees(store(dealt.mapInArrow(task, trees.TREES, barrier=True)), tuple(features))


def predict_boosting(model: BoostedTrees, rows: DataFrame, features: Sequence[str] | None = None, keep: Sequence[str] = ("datetime_15min",)) -> DataFrame:
    """Predictions, clipped at zero from below; of several seeds their mean. The trees go to the tasks, the rows stay in place."""
    names = list(features or model.features)
    forest = trees.Forest(model.nodes.collect())
    used = rows.select(*keep, *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keep) :]], 1)
            out = np.maximum(forest.predict(x), 0.0).mean(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out)], [*keep, "prediction"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[: len(keep)])
    return used.mapInArrow(run, f"{kept}, prediction double")


def importance(model: BoostedTrees) -> DataFrame:
    """(feature, importance), largest first: each feature's share of the gain of all splits."""
    spark = model.nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(model.features)), "i int, feature string")
    gain = model.nodes.where("feature >= 0").groupBy(F.col("feature").alias("i")).agg(F.sum("gain").alias("gain"))
    total = gain.select(F.sum("gain")).scalar()
    table = names.join(gain, "i", "left").select("feature", F.coalesce(F.try_divide("gain", total), F.lit(0.0)).alias("importance"))
    return table.orderBy(F.desc("importance"), "feature")


def boosted_forecast(
    matrix: DataFrame,
    start: str,
    end: str,
    settings: BoostingSettings = SCORED,
    features: Sequence[str] = ALL_FEATURES,
    seeds: Sequence[int] | None = None,
) -> DataFrame:
    """Fit on complete rows before `start`, predict every slot of [start, end).

    With several seeds their models grow in one job and the predictions are averaged slot by slot.
    """
    matrix = materialize(matrix)  # read by the count, the training rows, their medians and the prediction
    train = materialize(training_rows(matrix, start, features))
    rows = impute_medians(prediction_rows(matrix, start, end), train, features)
    return predict_boosting(fit_boosting(train, features, settings=settings, seeds=seeds), rows)


def ensemble_mean(runs: DataFrame) -> DataFrame:
    """Mean prediction per slot over stacked model runs."""
    return runs.groupBy("datetime_15min").agg(F.avg("prediction").alias("prediction"))
