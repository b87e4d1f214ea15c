"""Trip analytics: normalisation, splits, one-variable linear regression by gradient descent, pair statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.matrix import number_rows


def max_normalise(df: DataFrame, *columns: str) -> DataFrame:
    """Columns divided by their largest values; the one row of maxima is broadcast."""
    tops = df.agg(*(F.max(c).alias(f"__max_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(tops))
    for c in columns:
        out = out.withColumn(c, F.col(c) / F.col(f"__max_{c}"))
    return out.drop(*(f"__max_{c}" for c in columns))


def split(df: DataFrame, key: Column, train_tenths: int = 7) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the last digit of a key: no order, no shuffle, the same on every run."""
    is_train = F.pmod(key, F.lit(10)) < train_tenths
    return df.where(is_train), df.where(~is_train)


@dataclass(frozen=True)
class Fit:
    intercept: float
    slope: float
    train_error: float
    stale_train_error: float
    """The error by the parameters before the last update."""


def _sums(df: DataFrame, x: str, y: str) -> tuple[float, ...]:
    """n and the sums of x, x^2, y, xy, y^2: all that gradients and errors depend on, six numbers in one aggregation."""
    a, b = F.col(x), F.col(y)
    row = df.agg(F.count(F.lit(1)), F.sum(a), F.sum(a * a), F.sum(b), F.sum(a * b), F.sum(b * b)).first()
    return tuple(float(v or 0.0) for v in row)


def _half_mse(s: tuple[float, ...], p: float, q: float) -> float:
    n, x, xx, y, xy, yy = s
    return (n * p * p + 2 * p * q * x + q * q * xx - 2 * p * y - 2 * q * xy + yy) / (2 * n) if n else float("nan")


def fit_linear(df: DataFrame, x: str, y: str, updates: int = 51, rate: float = 0.1, start: tuple[float, float] = (1.0, 1.0)) -> Fit:
    """Least squares of y on [1, x] by gradient descent on the half mean squared error."""
    s = _sums(df, x, y)
    n, sx, sxx, sy, sxy, _ = s
    p, q = before = start
    for _ in range(updates if n else 0):
        before = p, q
        p, q = p - rate * (n * p + sx * q - sy) / n, q - rate * (sx * p + sxx * q - sxy) / n
    return Fit(p, q, _half_mse(s, p, q), _half_mse(s, *before))


def half_mse(df: DataFrame, x: str, y: str, fit: Fit) -> float:
    return _half_mse(_sums(df, x, y), fit.intercept, fit.slope)


def frequent_pairs(df: DataFrame, a: str, b: str, least: int = 50) -> DataFrame:
    """(a, b, count) of pairs of different values that occur often enough."""
    return df.where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)


def every_nth(df: DataFrame, n: int, *order_by: str) -> DataFrame:
    """Rows 0, n, 2n, ... by a total order."""
    return number_rows(df, order_by).where(F.col("__at") % n == 0).drop("__at")


def within(df: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys occur in ``others``."""
    return df.join(others.select(*keys), list(keys), "left_semi")


def without(df: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys do not occur in ``others``."""
    return df.join(others.select(*keys), list(keys), "left_anti")


def apply_refresh(df: DataFrame, inserts: DataFrame | None = None, deletes: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """A table after a refresh: rows named by ``deletes`` go, ``inserts`` come."""
    out = df if deletes is None else without(df, deletes, *keys)
    return out if inserts is None else out.unionByName(inserts)
