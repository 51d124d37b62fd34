"""Pearson and Spearman correlation, plain, lagged and against a target."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from terralag.operators.ordered import ROWS_PER_BUCKET, bucket_splits, running_total, running_totals

BROADCAST_VALUES = 20_000  # distinct values up to which a table of ranks is sent to every task


def safe_corr(x, y) -> Column:
    """Pearson correlation of complete pairs; NULL for a constant side, where ``corr`` may raise."""
    spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), spread)


def _pair_rows(agg: DataFrame, pairs: Sequence[tuple[str, str]], value: str) -> DataFrame:
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p_{i}").alias(value))
        for i, (a, b) in enumerate(pairs)
    ]
    return agg.select(F.inline(F.array(*cells)))


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, r)`` for each pair of columns, NULLs dropped per pair, in one aggregation."""
    pairs = list(combinations(columns, 2))
    both = [(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs]
    agg = df.agg(*[safe_corr(x, y).alias(f"p_{i}") for i, (x, y) in enumerate(both)])
    return _pair_rows(agg, pairs, "r")


def average_ranks(rows: DataFrame, value: str, out: str, keys: Sequence[str] = (), rows_per_bucket=ROWS_PER_BUCKET):
    """``(keys.., value, out)``: one row per distinct value with its average rank."""
    splits = bucket_splits(rows, F.col(value), rows_per_bucket)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, "_n", value, "_before", keys, splits=splits)
    return ranked.select(*keys, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))


def spearman_by_group(pairs: DataFrame, group: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(group, rho, n)`` from long rows ``(group, x, y)``; rows with a NULL side are left out.

    All groups are ranked in one job: counts per distinct value, prefix sums, ranks joined back.
    """
    rows = pairs.filter("x IS NOT NULL AND y IS NOT NULL")
    rank_x = average_ranks(rows, "x", "rx", [group], rows_per_bucket)
    rank_y = average_ranks(rows, "y", "ry", [group], rows_per_bucket)
    ranked = rows.join(rank_x, [group, "x"]).join(rank_y, [group, "y"])
    return ranked.groupBy(group).agg(safe_corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def conditional_ranks(
    df: DataFrame,
    column: str,
    groups: Sequence[tuple[Column, Column | None]],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    distinct: int | None = None,
) -> DataFrame:
    """``(v, ranks)``: per distinct value of ``column`` its average rank in each group.

    A group is (which rows count, what value the column takes there); the value may only depend on
    ``column``, None is the column itself. The table is read once. Distinct values are sorted once if all groups take
    the column itself, else they are expanded by group and sorted. A known number of ``distinct`` values that needs no
    buckets saves the scans for their edges.
    """
    few = distinct is not None and distinct <= rows_per_bucket
    splits = [] if few else bucket_splits(df, F.col(column).cast("double"), rows_per_bucket)
    counts = df.groupBy(column).agg(*[F.count_if(rows).alias(f"_n{i}") for i, (rows, _) in enumerate(groups)])
    if all(value is None for _, value in groups):
        counts = counts.select(F.col(column).alias("v"), *[f"_n{i}" for i in range(len(groups))]).filter("v IS NOT NULL")
        ranked = running_totals(counts, {f"_before{i}": f"_n{i}" for i in range(len(groups))}, "v", splits=splits)
        ranks = [F.when(F.col(f"_n{i}") > 0, F.col(f"_before{i}") + (F.col(f"_n{i}") + 1) / 2) for i in range(len(groups))]
        return ranked.select("v", F.array(*ranks).alias("ranks"))
    cells = [
        F.struct(
            F.lit(i).alias("g"), (F.col(column) if value is None else value).cast("double").alias("w"), F.col(f"_n{i}").alias("n")
        )
        for i, (_, value) in enumerate(groups)
    ]
    long = counts.select(F.col(column).alias("v"), F.inline(F.array(*cells))).filter("n > 0 AND w IS NOT NULL")
    totals = long.groupBy("g", "w").agg(F.sum("n").alias("n"))
    ranked = running_total(totals, "n", "w", "_before", ["g"], splits=splits)
    ranked = ranked.select("g", "w", (F.col("_before") + (F.col("n") + 1) / 2).alias("rank"))
    per_value = [F.max(F.when(F.col("g") == i, F.col("rank"))) for i in range(len(groups))]
    return long.join(ranked, ["g", "w"]).groupBy("v").agg(F.array(*per_value).alias("ranks"))


def with_ranks(df: DataFrame, ranks: dict[str, DataFrame], distinct: dict[str, int]) -> DataFrame:
    """``df`` with the ranks of each column as ``_r_<column>``; long tables are joined first, short ones are sent out."""
    for c in sorted(ranks, key=lambda c: distinct[c] <= BROADCAST_VALUES):
        table = ranks[c].withColumnsRenamed({"v": f"_v_{c}", "ranks": f"_r_{c}"})
        if distinct[c] <= BROADCAST_VALUES:
            table = F.broadcast(table)
        df = df.join(table, df[c].eqNullSafe(table[f"_v_{c}"]), "left").drop(f"_v_{c}")
    return df


def spearman_matrix(df: DataFrame, columns: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(a, b, rho)`` for each pair, average ranks for ties, complete per pair.

    A column is ranked once over all its rows and once more per other column that has gaps; all its
    rankings come from one pass over its values and are joined back by one join.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    seen = doubles.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)],
    ).first()
    gapped = [c for i, c in enumerate(columns) if seen[f"n{i}"]]
    distinct = {c: seen[f"d{i}"] for i, c in enumerate(columns)}
    ranks, place = {}, {}
    for c in columns:
        others = [None, *[o for o in gapped if o != c]]
        place |= {(c, o): i for i, o in enumerate(others, 1)}
        groups = [(F.lit(True) if o is None else F.col(o).isNotNull(), None) for o in others]
        ranks[c] = conditional_ranks(doubles, c, groups, rows_per_bucket, distinct[c])
    ranked = with_ranks(doubles, ranks, distinct)

    def rank(c: str, other: str) -> Column:
        # NULL where either side is missing: an unranked value leaves the pair incomplete
        return F.element_at(f"_r_{c}", place[(c, other if other in gapped else None)])

    agg = ranked.agg(*[safe_corr(rank(a, b), rank(b, a)).alias(f"p_{i}") for i, (a, b) in enumerate(pairs)])
    return _pair_rows(agg, pairs, "rho")


def _pair_moments(sides: Sequence[tuple[int, int]], shift: float):
    """Each task's sums over the rows that have both numbers of a pair, and the ends of either number."""

    def run(batches):
        total, low, high = np.zeros((len(sides), 6)), np.full((len(sides), 2), np.inf), np.full((len(sides), 2), -np.inf)
        for batch in batches:
            numbers = [batch.column(i).to_numpy(zero_copy_only=False) - shift for i in range(batch.num_columns)]
            there = [~np.isnan(x) for x in numbers]
            for at, (i, j) in enumerate(sides):
                both = there[i] & there[j]
                x, y = (numbers[i], numbers[j]) if both.all() else (numbers[i][both], numbers[j][both])
                if len(x):
                    total[at] += (len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y)
                    low[at] = np.minimum(low[at], (x.min(), y.min()))
                    high[at] = np.maximum(high[at], (x.max(), y.max()))
        columns = [np.arange(len(sides), dtype=np.int32), *total.T, *low.T, *high.T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_MOMENTS)

    return run


_MOMENTS = ["pair", "n", "sx", "sy", "sxx", "syy", "sxy", "low_x", "low_y", "high_x", "high_y"]


def pair_correlations(df: DataFrame, sides: Sequence[tuple[int, int]], shift: float = 0.0) -> DataFrame:
    """``(pair, rho)`` for each pair of places of double columns of ``df`` over its complete rows; NULL for a constant side.

    For many pairs: rows are not copied, a task sends one row per pair. ``shift`` is a number near the means, which keeps the sums short.
    """
    parts = df.mapInArrow(_pair_moments(sides, shift), ", ".join(f"{c} {'int' if c == 'pair' else 'double'}" for c in _MOMENTS))
    sums = parts.groupBy("pair").agg(
        *[F.sum(c).alias(c) for c in _MOMENTS[1:7]],
        *[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in _MOMENTS[7:]],
    )
    varies = (F.col("low_x") < F.col("high_x")) & (F.col("low_y") < F.col("high_y"))
    spread = F.sqrt(F.expr("sxx - sx * sx / n")) * F.sqrt(F.expr("syy - sy * sy / n"))
    return sums.filter("n > 0").select("pair", F.when(varies, F.try_divide(F.expr("sxy - sx * sy / n"), spread)).alias("rho"))


def spearman_with_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``(column, rho, n)`` of each column against ``target``."""
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.col(target).cast("double").alias("y")
        )
        for c in columns
    ]
    return spearman_by_group(df.select(F.inline(F.array(*cells))), "column")


def average_absolute(rho: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rho.groupBy(*by).agg(F.avg(F.abs("rho")).alias("avg_abs_corr_with_target"))


def strong_pairs(rho: DataFrame, threshold: float, value: str = "rho") -> DataFrame:
    """Pairs whose correlation is above ``threshold`` in size: candidates for leakage or collinearity."""
    return rho.filter(F.abs(value) > threshold)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 300):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p_value(r: float | None, n: int) -> float | None:
    """Two-sided p-value of ``t = r*sqrt((n-2)/(1-r^2))`` with n-2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    dof = n - 2
    t2 = r * r * dof / (1.0 - r * r)
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t2))


def spearman_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(rho, p_value, n)``; the driver only sees the two scalars rho and n."""
    rows = df.select(F.lit(0).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    got = spearman_by_group(rows, "g").first()
    rho, n = (got["rho"], got["n"]) if got else (None, 0)
    return df.sparkSession.createDataFrame(
        [(rho, correlation_p_value(rho, n), n)], "rho double, p_value double, n bigint"
    )


def cross_correlation(panel: DataFrame, key: str, ts: str, value: str, other: str, max_lag: int = 12) -> DataFrame:
    """``(key, lag, r)``: ``value`` lagged by 1..max_lag months against ``other``.

    ``panel`` is monthly, so the window per key is bounded by the calendar.
    """
    w = Window.partitionBy(key).orderBy(ts)
    lagged = panel.withColumns({f"lag_{i}": F.lag(value, i).over(w) for i in range(1, max_lag + 1)})
    agg = lagged.groupBy(key).agg(*[safe_corr(f"lag_{i}", other).alias(f"r_{i}") for i in range(1, max_lag + 1)])
    cells = [F.struct(F.lit(i).alias("lag"), F.col(f"r_{i}").alias("r")) for i in range(1, max_lag + 1)]
    return agg.select(key, F.inline(F.array(*cells)))


def component_correlation(
    panel: DataFrame, key: str, ts: str, value: str, other: str, residual: str | None = None
) -> DataFrame:
    """``(key, a, b, r)`` among AR(1), AR(2), MA(1), MA(2) and ``other``, rows with a NULL left out.

    The MA terms are lagged residuals of a fitted model, when ``residual`` names such a column.
    """
    w = Window.partitionBy(key).orderBy(ts)
    parts = {"AR(1)": F.lag(value, 1).over(w), "AR(2)": F.lag(value, 2).over(w)}
    if residual:
        parts |= {"MA(1)": F.lag(residual, 1).over(w), "MA(2)": F.lag(residual, 2).over(w)}
    parts[other] = F.col(other)
    names = list(parts)
    rows = panel.select(key, *[c.alias(f"c_{i}") for i, c in enumerate(parts.values())]).dropna()
    pairs = list(combinations(range(len(names)), 2))
    agg = rows.groupBy(key).agg(*[safe_corr(f"c_{i}", f"c_{j}").alias(f"p_{i}_{j}") for i, j in pairs])
    cells = [
        F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"p_{i}_{j}").alias("r"))
        for i, j in pairs
    ]
    return agg.select(key, F.inline(F.array(*cells)))
