"""Boosted trees of one barrier job against plain trees, MLlib, and themselves under other layouts."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from loadweave.plans import boosting, trees


def table(n, seed=1, features=4):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, features)).round(2)
    y = 100 + 30 * np.sin(x[:, 0] * 2) + 20 * (x[:, 1] > 0.3) * x[:, 2] + rnd.normal(size=n)
    return x, y


def frame(spark, x, y):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, y double, " + ", ".join(f"{n} double" for n in names)), names


def best(x, r, rows, cuts, min_leaf):
    """(gain, feature, cut) of the best split of some rows, by trying all."""
    out = None
    for f in range(x.shape[1]):
        for c in cuts[f]:
            low = rows[x[rows, f] <= c]
            if min(len(low), len(rows) - len(low)) >= min_leaf:
                high = rows[x[rows, f] > c]
                gain = r[low].sum() ** 2 / len(low) + r[high].sum() ** 2 / len(high) - r[rows].sum() ** 2 / len(rows)
                if gain > 1e-9 and (out is None or gain > out[0] + 1e-9):
                    out = gain, f, c
    return out


def plain_model(x, y, rounds, rate, min_leaf, bins, depth=None, leaves=None):
    """Fitted values and the number of leaves of each tree, with best-first or level-wise growth."""
    cuts = [trees.edges(x[:, f], bins) for f in range(x.shape[1])]
    fitted, counts = np.full(len(y), y.mean()), []
    for _ in range(rounds):
        r = y - fitted
        done, open_ = [], [(0, np.arange(len(y)))]
        while open_:
            if leaves is None:
                d, rows = open_.pop()
                split = best(x, r, rows, cuts, min_leaf) if d < depth else None
            else:
                splits = [best(x, r, rows, cuts, min_leaf) for _, rows in open_]
                if len(open_) >= leaves or not any(splits):
                    done += [rows for _, rows in open_]
                    break
                k = max(range(len(open_)), key=lambda i: splits[i][0] if splits[i] else -1)
                (d, rows), split = open_.pop(k), splits[k]
            if split is None:
                done.append(rows)
                continue
            low = x[rows, split[1]] <= split[2]
            open_ += [(d + 1, rows[low]), (d + 1, rows[~low])]
        counts.append(len(done))
        for rows in done:
            fitted[rows] += rate * r[rows].mean()
    return fitted, counts


def leaf_counts(model):
    return [r["n"] for r in model.nodes.where("round >= 0 AND feature < 0").groupBy("round").agg(F.count("*").alias("n")).orderBy("round").collect()]


def predictions(model, df):
    return np.array([r["prediction"] for r in boosting.predict_boosting(model, df, keep=("id",)).orderBy("id").collect()])


@pytest.mark.parametrize("settings", [boosting.BoostingSettings(6, 3, 0.3, 1.0, 5), boosting.BoostingSettings(6, None, 0.3, 1.0, 8, leaves=9)])
def test_trees_equal_plain_ones(spark, settings):
    x, y = table(300)
    df, names = frame(spark, x, y)
    model = boosting.fit_boosting(df, names, "y", settings)
    want, counts = plain_model(x, y, settings.rounds, settings.learning_rate, settings.min_leaf, settings.bins, settings.depth, settings.leaves)
    assert leaf_counts(model) == counts
    assert np.allclose(predictions(model, df), want, rtol=0, atol=1e-4)
    assert model.nodes.where(f"round >= 0 AND n < {settings.min_leaf}").isEmpty()


@pytest.mark.parametrize("settings,leaves", [(boosting.LEAF_31, 31), (boosting.LEAF_63, 63)])
def test_leaf_wise_trees_have_all_their_leaves(spark, settings, leaves):
    df, names = frame(spark, *table(8_000))
    few = boosting.BoostingSettings(**{**settings.__dict__, "rounds": 3})
    model = boosting.fit_boosting(df, names, "y", few)
    assert leaf_counts(model) == [leaves] * 3
    assert model.nodes.where(f"round >= 0 AND n < {settings.min_leaf}").isEmpty()
    assert model.nodes.agg(F.max("depth")).first()[0] > 6


@pytest.mark.parametrize("leaves", [None, 12])
def test_a_model_does_not_change_with_the_layout_or_the_number_of_tasks(spark, leaves):
    df, names = frame(spark, *table(2_000))
    settings = boosting.BoostingSettings(5, 4, 0.2, 0.7, 5, bins=32, leaves=leaves)
    found = {
        tuple(sorted(map(tuple, boosting.fit_boosting(df.repartition(n), names, "y", settings, tasks=t).nodes.collect()))) for n, t in ((1, 1), (7, 2), (3, 8))
    }
    assert len(found) == 1


def test_models_grown_side_by_side_equal_single_ones(spark):
    df, names = frame(spark, *table(1_000))
    settings = boosting.BoostingSettings(4, 3, 0.3, 0.6, 5)
    together = boosting.fit_boosting(df, names, "y", settings, seeds=[1, 2, 3])
    single = [boosting.fit_boosting(df, names, "y", settings, seeds=[s]) for s in (1, 2, 3)]
    rows = [tuple(r) for m in single for r in m.nodes.collect()]
    assert sorted(map(tuple, together.nodes.collect())) == sorted(rows)
    assert np.allclose(predictions(together, df), np.mean([predictions(m, df) for m in single], 0))
    assert len({m.nodes.where("round = 0 AND node = 1").first()["threshold"] for m in single}) > 1


def test_error_is_close_to_that_of_mllib(spark):
    x, y = table(3_000)
    df, names = frame(spark, x, y)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    other = GBTRegressor(labelCol="y", maxIter=50, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=10, maxBins=64, seed=1).fit(rows)
    theirs = np.array([r["prediction"] for r in other.transform(rows).orderBy("id").collect()])
    ours = predictions(boosting.fit_boosting(df, names, "y", boosting.BoostingSettings(50)), df)
    # the first tree of MLlib is not scaled by the rate, so it is a few rounds ahead
    ahead = predictions(boosting.fit_boosting(df, names, "y", boosting.BoostingSettings(70)), df)
    errors = [np.abs(p - y).mean() for p in (theirs, ours, ahead)]
    assert errors[2] <= errors[0] * 1.05 and errors[1] < np.abs(y - y.mean()).mean() / 3


def test_shares_of_gain_and_constant_columns(spark):
    x, y = table(500)
    x[:, 3] = 7.0
    df, names = frame(spark, x, y)
    out = {r["feature"]: r["importance"] for r in boosting.importance(boosting.fit_boosting(df, names, "y", boosting.BoostingSettings(5, 3))).collect()}
    assert out["f3"] == 0.0 and sum(out.values()) == pytest.approx(1.0) and out["f0"] == max(out.values())


def test_few_rows_equal_rows_and_none(spark):
    settings = boosting.BoostingSettings(3, 2, min_leaf=1)
    one, names = frame(spark, np.zeros((1, 2)), np.array([5.0]))
    assert predictions(boosting.fit_boosting(one, names, "y", settings), one).tolist() == [5.0]
    same, _ = frame(spark, np.ones((40, 2)), np.full(40, -3.0))
    assert predictions(boosting.fit_boosting(same, names, "y", settings), same).tolist() == [0.0] * 40
    none = boosting.fit_boosting(one, names, "y", boosting.BoostingSettings(0))
    assert none.nodes.count() == 1 and predictions(none, one).tolist() == [5.0]
    with pytest.raises(ValueError):
        boosting.fit_boosting(one.limit(0), names, "y", settings)


def test_a_round_draws_its_share_of_the_rows():
    rows = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    drawn = [trees.drawn(rows, s, t, 0.8) for s in (1, 2) for t in range(3)]
    assert all(abs(len(d) / 20_000 - 0.8) < 0.02 for d in drawn)
    assert len({tuple(d[:50]) for d in drawn}) == 6 and len(trees.drawn(rows, 1, 0, 1.0)) == 20_000


def test_training_is_one_barrier_job_whatever_the_rounds(spark):
    df, names = frame(spark, *table(400))
    tracker = spark.sparkContext.statusTracker()

    def jobs(rounds):
        group = f"boost-{rounds}-{dt.datetime.now().timestamp()}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.fit_boosting(df, names, "y", boosting.BoostingSettings(rounds, 3))
        spark.sparkContext.setJobGroup("none", "none")
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(2) == jobs(40)
