"""Feature scaling, expansion and univariate selection with the scikit-learn conventions.

Parameters are fitted as a handful of scalars; applying them is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement
from math import inf, prod

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from terralag.operators.correlation import safe_corr
from terralag.operators.quantiles import exact_quantiles


Affine = dict[str, tuple[float | None, float | None]]


def apply_affine(df: DataFrame, params: Affine) -> DataFrame:
    """``(x - shift) / scale``; a zero scale counts as one, so a constant column becomes 0."""
    return df.withColumns(
        {
            c: (F.col(c).cast("double") - F.lit(shift)) / F.lit(scale or 1.0)
            for c, (shift, scale) in params.items()
            if shift is not None
        }
    )


def fit_standard(df: DataFrame, columns: Sequence[str]) -> Affine:
    row = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> Affine:
    row = df.agg(*[f(c).cast("double") for c in columns for f in (F.min, F.max)]).first()
    ends = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}
    return {c: (low, None if low is None else high - low) for c, (low, high) in ends.items()}


def fit_robust(df: DataFrame, columns: Sequence[str]) -> Affine:
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return {c: (m, None if m is None else b - a) for c, (a, m, b) in q.items()}


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean, unit population standard deviation."""
    return apply_affine(df, fit_standard(df, columns))


def minmax_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """To [0, 1]; a constant column becomes 0."""
    return apply_affine(df, fit_minmax(df, columns))


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median to 0, interquartile range to 1."""
    return apply_affine(df, fit_robust(df, columns))


# Acklam's rational approximation of the normal quantile: fixed coefficients
_CENTRE_NUM = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_DEN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL_AT = 0.02425
_NORMAL_CLIP = 5.19933758270342  # where the transformer cuts its normal output: a fixed value


def _doubles(values: Sequence[float]) -> Column:
    """A constant array, folded to one literal when the plan is optimised."""
    return F.expr(f"CAST(split('{','.join(repr(float(v)) for v in values)}', ',') AS ARRAY<DOUBLE>)")


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    # written out, the four polynomials of a few columns make a method too long for the JIT
    return F.aggregate(_doubles(coefficients), F.lit(0.0), lambda total, c: total * x + c)


def probit(p: Column) -> Column:
    """Standard normal quantile of ``p``, clipped to +-5.2 (relative error about 1e-9)."""
    r = p - 0.5
    q = F.least(p, 1.0 - p)
    side = F.sqrt(-2.0 * F.ln(q))
    tail = (
        F.when(q <= 1e-7, F.lit(-_NORMAL_CLIP))
        .when(q < _TAIL_AT, _horner(_TAIL_NUM, side) / _horner(_TAIL_DEN, side))
    )
    value = F.coalesce(F.when(p > 0.5, -tail).otherwise(tail), r * _horner(_CENTRE_NUM, r * r) / _horner(_CENTRE_DEN, r * r))
    # greatest and least skip nulls
    return F.when(p.isNotNull(), F.greatest(F.least(value, F.lit(_NORMAL_CLIP)), F.lit(-_NORMAL_CLIP)))


def quantile_transform(df: DataFrame, columns: Sequence[str], n: int = 100, output: str = "normal") -> DataFrame:
    """Map each column through its own ``n``-point empirical distribution."""
    return apply_quantiles(df, fit_quantiles(df, columns, n), output)


def fit_quantiles(df: DataFrame, columns: Sequence[str], n: int = 100, **limits: int) -> dict[str, list[float | None]]:
    """``n`` evenly spaced quantiles of each column, ends included; ``limits`` as in ``exact_quantiles``."""
    return exact_quantiles(df, columns, [i / (n - 1) for i in range(n)], **limits)


def apply_quantiles(df: DataFrame, points: dict[str, list[float | None]], output: str = "normal") -> DataFrame:
    """Map each column through the distribution given by its points, interpolating between them.

    A value that several points share gets the middle of their range. ``output`` is ``uniform`` or
    ``normal``. Lookups are a binary search in the JVM (Bucketizer), not a scan of the points, and all columns
    go through the same few projections.
    """
    known = {c: values for c, values in points.items() if values[0] is not None}
    if not known:
        return df
    tables, uniform = {}, {}
    for c, values in known.items():
        first, last = {}, {}
        for i, v in enumerate(values):
            first.setdefault(v, i / (len(values) - 1))
            last[v] = i / (len(values) - 1)
        xs = sorted(first)
        if len(xs) == 1:
            uniform[c] = F.when(F.col(c).cast("double").isNotNull(), F.lit(0.0))
        else:
            tables[c] = (xs, [first[v] for v in xs], [last[v] for v in xs])
    out, work = df, []
    if tables:
        place = {c: (f"_quantile_x{i}", f"_quantile_k{i}") for i, c in enumerate(tables)}
        work = [n for pair in place.values() for n in pair]
        cut = Bucketizer(
            splitsArray=[[-inf, *xs, inf] for xs, _, _ in tables.values()],
            inputCols=[x for x, _ in place.values()],
            outputCols=[k for _, k in place.values()],
            handleInvalid="keep",
        )
        out = cut.transform(out.withColumns({x: F.col(c).cast("double") for c, (x, _) in place.items()}))
        # each step is its own projection, so nothing is computed twice
        out = out.withColumns({k: F.greatest(F.least(F.col(k).cast("int"), F.lit(len(tables[c][0]) - 1)), F.lit(1)) for c, (_, k) in place.items()})
        for c, (xs, first, last) in tables.items():
            x, k = (F.col(n) for n in place[c])
            x0, x1 = F.element_at(_doubles(xs), k), F.element_at(_doubles(xs), k + 1)
            g0, g1 = F.element_at(_doubles(last), k), F.element_at(_doubles(first), k + 1)
            middle = F.element_at(_doubles([(a + b) / 2 for a, b in zip(first, last)]), k)
            uniform[c] = (
                F.when(x <= xs[0], F.lit(0.0))
                .when(x >= xs[-1], F.lit(1.0))
                .when(x == x0, middle)
                .when(x.isNotNull(), g0 + (g1 - g0) * F.try_divide(x - x0, x1 - x0))
            )
    out = out.withColumns(uniform).drop(*work)
    return out.withColumns({c: probit(F.col(c)) for c in known}) if output == "normal" else out


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 3) -> DataFrame:
    """Add every product of up to ``degree`` columns, named like ``a*a*b``; no constant term."""
    terms = {}
    for size in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, size):
            terms["*".join(combo)] = prod((F.col(c).cast("double") for c in combo[1:]), start=F.col(combo[0]).cast("double"))
    return df.withColumns(terms)


def variance_threshold(df: DataFrame, columns: Sequence[str], threshold: float = 0.001) -> list[str]:
    """Columns whose population variance is above ``threshold``."""
    row = df.agg(*[F.var_pop(c) for c in columns]).first()
    return [c for c, v in zip(columns, row) if v is not None and v > threshold]


def f_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``(column, f_score)`` of the univariate linear regressions on ``target``; rows are complete cases."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in [*columns, target]]).dropna()
    agg = rows.agg(F.count(F.lit(1)).alias("n"), *[safe_corr(c, target).alias(f"r_{i}") for i, c in enumerate(columns)])
    cells = []
    for i, c in enumerate(columns):
        r2 = F.pow(F.col(f"r_{i}"), F.lit(2.0))
        score = F.try_divide(r2, 1.0 - r2) * (F.col("n") - 2)
        cells.append(F.struct(F.lit(c).alias("column"), score.alias("f_score")))
    return agg.select(F.inline(F.array(*cells)))


def select_k_best(df: DataFrame, columns: Sequence[str], target: str, k: int = 5) -> DataFrame:
    return f_scores(df, columns, target).orderBy(F.col("f_score").desc_nulls_last(), "column").limit(k)
