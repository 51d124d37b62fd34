"""Augmented Dickey-Fuller test for many series."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

# MacKinnon (1994) response surface for one variable with a constant.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def series_arrays(panel: DataFrame, key: str, ts: str, values: Sequence[str]) -> DataFrame:
    """One row per key with time-ordered arrays. ``panel`` holds one row per key and month."""
    packed = panel.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(ts, *values))).alias("_s"))
    return packed.select(key, *[F.col(f"_s.{c}").alias(c) for c in (ts, *values)])


def adf_p_value(stat: float) -> float:
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    coefs = SMALL_P if stat <= TAU_STAR else LARGE_P
    z = sum(c * stat**i for i, c in enumerate(coefs))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _ols(x: np.ndarray, y: np.ndarray):
    coef, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ coef
    return coef, float(resid @ resid)


def adf(y: np.ndarray) -> tuple[float, float, int] | None:
    """(statistic, p-value, lags): constant term, lag order by AIC on the common sample."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    top = min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2)
    if top < 0 or np.ptp(y) == 0:
        return None
    dy = np.diff(y)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, len(dy))
        cols = [y[rows], np.ones(len(rows)), *[dy[rows - i] for i in range(1, lags + 1)]]
        return np.column_stack(cols), dy[rows]

    best, lags = math.inf, 0
    for k in range(top + 1):
        x, target = design(k, top)
        _, sse = _ols(x, target)
        m = len(target)
        aic = m * math.log(max(sse, 1e-300) / m) + 2 * x.shape[1]
        if aic < best:
            best, lags = aic, k
    x, target = design(lags, lags)
    coef, sse = _ols(x, target)
    dof = len(target) - x.shape[1]
    if dof <= 0:
        return None
    spread = sse / dof * np.linalg.pinv(x.T @ x)[0, 0]
    if spread <= 0:
        return None
    stat = float(coef[0] / math.sqrt(spread))
    return stat, adf_p_value(stat), lags


def unit_root_tests(panel: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``(key, form, statistic, p_value, lags, stationary)`` per series.

    ``form`` is ``level``, and also ``difference`` where the level's p-value is at least 0.05.
    """
    arrays = series_arrays(panel.filter(F.col(value).isNotNull()), key, ts, [value]).select(key, value)
    kind = dict(arrays.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, y in zip(batch[key], batch[value]):
                level = adf(y)
                tests = [("level", level)]
                if level is not None and level[1] >= 0.05:
                    tests.append(("difference", adf(np.diff(y))))
                for form, got in tests:
                    stat, p, lags = got if got is not None else (None, None, None)
                    rows.append((name, form, stat, p, lags, None if p is None else p < 0.05))
            yield pd.DataFrame(rows, columns=[key, "form", "statistic", "p_value", "lags", "stationary"]).astype(
                {"statistic": "float64", "p_value": "float64", "lags": "Int64", "stationary": "boolean"}
            )

    schema = f"`{key}` {kind}, form string, statistic double, p_value double, lags bigint, stationary boolean"
    return arrays.mapInPandas(run, schema)


def dickey_fuller_lag0(panel: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``(key, statistic)`` without lag terms, from regression aggregates only."""
    w = Window.partitionBy(key).orderBy(ts)
    prev = F.lag(value).over(w)
    rows = panel.withColumns({"_p": prev, "_d": F.col(value) - prev})
    sxx, syy, sxy = F.regr_sxx("_d", "_p"), F.regr_syy("_d", "_p"), F.regr_sxy("_d", "_p")
    dof = F.regr_count("_d", "_p") - 2
    slope = F.try_divide(sxy, sxx)
    error = F.sqrt(F.try_divide(F.try_divide(syy - slope * sxy, dof), sxx))
    return rows.groupBy(key).agg(F.try_divide(slope, error).alias("statistic"))
