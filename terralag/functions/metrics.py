"""Forecast and regression metrics as aggregate Columns.

Three percentage errors exist and are named apart: ``mape_fraction`` (0..1 scale),
``mape_percent`` (times 100) and ``mape_percent_eps`` (times 100, denominator plus 1e-8).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

MAPE_EPS = 1e-8  # fixed value of the third metric


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mape_fraction(y: Column, p: Column) -> Column:
    return F.avg(F.abs(F.try_divide(y - p, y)))


def mape_percent(y: Column, p: Column) -> Column:
    return F.lit(100.0) * mape_fraction(y, p)


def mape_percent_eps(y: Column, p: Column) -> Column:
    return F.lit(100.0) * F.avg(F.abs(F.try_divide(y - p, y + F.lit(MAPE_EPS))))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; SST comes from the population variance, so one pass is enough."""
    both = y.isNotNull() & p.isNotNull()
    return F.lit(1.0) - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(F.when(both, y)))


METRICS = {
    "rmse": rmse,
    "mae": mae,
    "mape_fraction": mape_fraction,
    "mape_percent": mape_percent,
    "mape_percent_eps": mape_percent_eps,
    "r2": r2,
}


def evaluate(
    df: DataFrame,
    actual: str,
    predicted: str,
    by: Sequence[str] = (),
    metrics: Sequence[str] = ("rmse", "mae", "mape_percent", "r2"),
) -> DataFrame:
    """All metrics in one aggregation, per ``by`` group."""
    y, p = F.col(actual), F.col(predicted)
    return df.groupBy(*by).agg(*[METRICS[m](y, p).alias(m) for m in metrics])


def fold_summary(folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of each metric over the folds."""
    aggs = [
        f(m).alias(f"{m}_{suffix}") for m in metrics for f, suffix in ((F.avg, "mean"), (F.stddev_pop, "std"))
    ]
    return folds.groupBy(*by).agg(*aggs)
