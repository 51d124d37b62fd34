"""Outlier treatment.

A treatment is described by bounds per column. Bounds are scalars on the driver; applying them is
one narrow filter or projection that Catalyst can push down. The input is read once per bound step,
so stage it first (``cut_lineage``) when it is expensive to compute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from terralag.functions.scalars import clip, mask_outside
from terralag.operators.profile import medians_and_mads
from terralag.operators.quantiles import exact_quantiles
from terralag.schemas import numeric_columns

Bounds = dict[str, tuple[float | None, float | None]]


def _columns(df: DataFrame, columns: Sequence[str] | None, target: str | None) -> list[str]:
    names = list(columns) if columns is not None else numeric_columns(df)
    return [c for c in names if c != target]


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], factor: float = 3.0, rows_at_most: int | None = None
) -> Bounds:
    out: Bounds = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75], rows_at_most=rows_at_most).items():
        out[c] = (None, None) if q1 is None else (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def robust_z_bounds(
    df: DataFrame, columns: Sequence[str], threshold: float, rows_at_most: int | None = None
) -> Bounds:
    """Median plus or minus ``threshold`` scaled MADs. Columns with MAD 0 get no bounds."""
    return {
        c: (m - threshold * d, m + threshold * d)
        for c, (m, d) in medians_and_mads(df, columns, rows_at_most).items()
        if d
    }


def keep_inside(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Rows inside all bounds. NULLs drop out; a column without any value keeps nothing."""
    for c, (low, high) in bounds.items():
        df = df.filter(F.col(c).between(F.lit(low).cast("double"), F.lit(high).cast("double")))
    return df


def null_outside(df: DataFrame, bounds: Bounds) -> DataFrame:
    known = {c: b for c, b in bounds.items() if b[0] is not None}
    return df.withColumns({c: mask_outside(F.col(c), F.lit(a), F.lit(b)) for c, (a, b) in known.items()})


def sequential_iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = 3.0) -> Bounds:
    """Bounds where each column is judged on the rows its predecessors kept (order matters)."""
    bounds: Bounds = {}
    n = df.count()
    for c in columns:
        bounds[c] = iqr_bounds(keep_inside(df, bounds), [c], factor, n)[c]
    return bounds


def sequential_z_bounds(df: DataFrame, columns: Sequence[str], threshold: float = 4.0) -> Bounds:
    bounds: Bounds = {}
    n = df.count()
    for c in columns:
        bounds.update(robust_z_bounds(keep_inside(df, bounds), [c], threshold, n))
    return bounds


def remove_outliers_iqr(
    df: DataFrame,
    factor: float = 3.0,
    columns: Sequence[str] | None = None,
    target: str | None = None,
    mode: str = "sequential",
) -> DataFrame:
    """Keep rows inside ``[Q1 - f*IQR, Q3 + f*IQR]`` of every column (``target`` is skipped).

    ``sequential`` recomputes the quartiles column by column in schema order: one job per column.
    ``joint`` takes all bounds from the input in one job and filters once.
    """
    names = _columns(df, columns, target)
    make = sequential_iqr_bounds if mode == "sequential" else iqr_bounds
    return keep_inside(df, make(df, names, factor))


def mask_outliers_iqr(df, factor: float = 3.0, columns=None, target=None) -> DataFrame:
    """NULL instead of dropping; all bounds from the input, one pass."""
    return null_outside(df, iqr_bounds(df, _columns(df, columns, target), factor))


def remove_outliers_robust_z(df, threshold: float = 4.0, columns=None, target=None) -> DataFrame:
    """Drop rows more than ``threshold`` scaled MADs from the median, column after column.

    NULLs are kept out of the MAD (the original lets one NULL void the column) and drop out.
    """
    return keep_inside(df, sequential_z_bounds(df, _columns(df, columns, target), threshold))


def mask_outliers_robust_z(df, threshold: float = 3.0, columns=None, target=None) -> DataFrame:
    return null_outside(df, robust_z_bounds(df, _columns(df, columns, target), threshold))


def winsor_bounds(df: DataFrame, columns: Sequence[str], lower: float = 0.05, upper: float = 0.95) -> Bounds:
    return {c: (a, b) for c, (a, b) in exact_quantiles(df, columns, [lower, upper]).items() if a is not None}


def winsorize(df, lower: float = 0.05, upper: float = 0.95, columns=None, target=None) -> DataFrame:
    """Clip each column to its quantiles; NULLs stay."""
    bounds = winsor_bounds(df, _columns(df, columns, target), lower, upper)
    return df.withColumns({c: clip(F.col(c), F.lit(a), F.lit(b)) for c, (a, b) in bounds.items()})
