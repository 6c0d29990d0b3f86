"""Ordinary least squares by sweeping one matrix of sums, and feature selection by it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators.sampling import sample_at_most
from ..session import materialize

COEFFICIENTS = "feature string, coefficient double, std_error double, t_value double, p_value double, r2 double, adj_r2 double, n bigint"
#: A column of which earlier ones explain all but this share is dependent
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Sums:
    """What regressions need of the rows: their number, and means, deviations and correlations of the columns."""

    columns: list[str]
    n: int
    mean: np.ndarray
    spread: np.ndarray
    correlation: np.ndarray


def sums(df: DataFrame, columns: Sequence[str]) -> Sums:
    """Two aggregates over stored rows without nulls; a square of the number of columns reaches the driver.

    Products are summed of centred and scaled values, so that no digits are lost.
    """
    columns = list(columns)
    first = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    n, k = int(first[0]), len(columns)
    mean, spread = (np.array([float(v or 0.0) for v in first[i : i + k]]) for i in (1, 1 + k))
    values = [(F.col(c) - F.lit(float(m))) / F.lit(float(s or 1.0)) for c, m, s in zip(columns, mean, spread)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = df.agg(*[F.sum(values[i] * values[j]) for i, j in pairs]).first() if pairs else []
    correlation = np.zeros((k, k))
    for (i, j), v in zip(pairs, found):
        correlation[i, j] = correlation[j, i] = float(v or 0.0) / max(1, n)
    return Sums(columns, n, mean, spread, correlation)


def sweep(matrix: np.ndarray, k: int) -> np.ndarray:
    """The symmetric matrix swept on row k: that variable moves to the explaining ones."""
    row, column, pivot = matrix[k].copy(), matrix[:, k].copy(), matrix[k, k]
    out = matrix - np.outer(column, row) / pivot
    out[k], out[:, k] = row / pivot, -column / pivot
    out[k, k] = 1.0 / pivot
    return out


def swept(s: Sums, features: Sequence[str], tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[int], list[str]]:
    """The correlations swept on all independent features in order; (matrix, their places, names of the others: constants, then dependent ones)."""
    matrix, kept, constant, dependent = s.correlation.copy(), [], [], []
    for name in features:
        k = s.columns.index(name)
        if not s.spread[k]:
            constant.append(name)
        elif matrix[k, k] < tolerance:
            dependent.append(name)
        else:
            matrix = sweep(matrix, k)
            kept.append(k)
    return matrix, kept, constant + dependent


def independent_columns(df: DataFrame, columns: Sequence[str], tolerance: float = TOLERANCE) -> tuple[list[str], list[str]]:
    """(kept, dropped): constants and columns that earlier ones explain are dropped."""
    s = sums(df, columns)
    _, kept, dropped = swept(s, columns, tolerance)
    return [s.columns[k] for k in kept], dropped


def two_sided(t: float, freedom: int) -> float:
    """The chance of a t value at least this far from 0, by the continued fraction of the incomplete beta function."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
        total = d
        for m in range(1, 500):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1.0 + term * d)
                c = 1.0 + term / c
                total *= c * d
            if abs(c * d - 1.0) < 1e-15:
                break
        return front * total

    if x <= 0:
        return 0.0
    return fraction(x, a, b) if x < (a + 1) / (a + b + 2) else 1.0 - fraction(1 - x, b, a)


def _fitted(s: Sums, features: Sequence[str], target: str, standardised: bool) -> tuple[list[tuple], list[str]]:
    """Rows of COEFFICIENTS and the dropped columns."""
    y = s.columns.index(target)
    matrix, kept, dropped = swept(s, features)
    freedom = s.n - len(kept) - 1
    left = max(0.0, float(matrix[y, y])) if s.spread[y] else 0.0
    r2 = 1.0 - left if s.spread[y] else 0.0
    adjusted = 1.0 - left * (s.n - 1) / freedom if freedom > 0 else float("nan")
    noise = left * s.spread[y] ** 2 * s.n / freedom if freedom > 0 else float("nan")
    scale = np.ones(len(s.columns)) if standardised else np.where(s.spread > 0, s.spread, 1.0)
    slopes = [float(matrix[k, y] * s.spread[y] / scale[k]) for k in kept]
    errors = [math.sqrt(noise * matrix[k, k] / s.n) / scale[k] if freedom > 0 else float("nan") for k in kept]
    if not standardised:
        level = s.mean[kept] / scale[kept] if kept else np.zeros(0)
        slopes.append(float(s.mean[y] - sum(b * s.mean[k] for b, k in zip(slopes, kept))))
        errors.append(math.sqrt(noise / s.n * (1 + level @ matrix[np.ix_(kept, kept)] @ level)) if freedom > 0 else float("nan"))
    rows = []
    for name, b, e in zip([*(s.columns[k] for k in kept), "intercept"], slopes, errors):
        t = b / e if e and e == e else (math.inf * b if b and e == 0 else float("nan"))
        p = two_sided(t, freedom) if t == t and math.isfinite(t) else (0.0 if t == t else float("nan"))
        rows.append((name, b, float(e), float(t), float(p), r2, adjusted, s.n))
    return rows, dropped


def fit_ols(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Coefficients with p-values; one row per independent feature plus the intercept. Rows with nulls take no part.

    The k + 1 columns are stored first, for two aggregates go over them. Dependent and constant columns are left out.
    """
    rows = materialize(df.select(*features, target).dropna())
    found, _ = _fitted(sums(rows, [*features, target]), features, target, standardised=False)
    return df.sparkSession.createDataFrame(found, COEFFICIENTS)


def predict_ols(coefficients: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add `prediction`; the coefficients come in as one map through a scalar subquery."""
    by_name = F.map_from_entries(F.collect_list(F.struct("feature", "coefficient")))
    beta = coefficients.select(by_name).scalar()
    terms = (F.coalesce(beta[f], F.lit(0.0)) * F.col(f) for f in features)
    return rows.withColumn("prediction", sum(terms, beta["intercept"]))


def ols_selection(
    df: DataFrame, features: Sequence[str], target: str, max_rows: int | None = None, keys: Sequence[str] = ("datetime_15min",)
) -> DataFrame:
    """Rank standardised features by |coefficient| and mark those worth keeping.

    A feature is selected if p < 0.05 and its |coefficient| reaches the median
    of the significant ones.  Dropped dependent columns are listed with nulls.
    All complete rows are used unless `max_rows` asks for a random subset.
    """
    rows = materialize(df.select(*dict.fromkeys([*keys, *features, target])).dropna(subset=[*features, target]))
    if max_rows is not None:
        rows = sample_at_most(rows, max_rows, keys)
    found, dropped = _fitted(sums(rows, [*features, target]), features, target, standardised=True)
    out = df.sparkSession.createDataFrame(found, COEFFICIENTS).withColumn("abs_coefficient", F.abs("coefficient"))
    p = F.col("p_value")
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    out = out.withColumn("significance", stars)
    median = out.where(p < 0.05).select(F.percentile("abs_coefficient", 0.5)).scalar()
    chosen = (p < 0.05) & (F.col("abs_coefficient") >= median)
    out = out.withColumn("selected", F.coalesce(chosen, F.lit(False)))
    if dropped:
        gone = df.sparkSession.createDataFrame([(c, False) for c in dropped], "feature string, selected boolean")
        out = out.unionByName(gone, allowMissingColumns=True)
    return out.orderBy(F.desc_nulls_last("abs_coefficient"), "feature")
