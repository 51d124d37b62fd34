"""Residual diagnostics of fitted series models, as data: correlogram, portmanteau, normality and normal scores.

Residuals are ``(key, ts, residual)`` rows; those without a residual are left out. A series is monthly, so a window
per key is bounded by the calendar.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from terralag.functions.special import chi_square_tail
from terralag.operators.scaling import probit


@F.pandas_udf(DoubleType())
def chi_square_p(stat: pd.Series, freedom: pd.Series) -> pd.Series:
    """Upper tails; one row per series and lag, after all aggregation."""
    return pd.Series([None if pd.isna(x) or n < 1 else chi_square_tail(float(x), float(n)) for x, n in zip(stat, freedom)], dtype="float64")


def _centred(residuals: DataFrame, key: str, ts: str) -> DataFrame:
    rows = residuals.filter("residual IS NOT NULL").select(key, ts, F.col("residual").cast("double").alias("residual"))
    return rows.withColumn("_e", F.col("residual") - F.avg("residual").over(Window.partitionBy(key)))


def autocorrelations(residuals: DataFrame, key: str, ts: str, lags: int = 12, used: int | Column = 0) -> DataFrame:
    """``(key, lag, r, q, p_value)``: autocorrelation by lag and the portmanteau statistic up to that lag.

    ``q = n (n + 2) * sum of r_i^2 / (n - i)``. The p-value is the chi-square tail with ``lag - used`` degrees of freedom,
    where ``used`` counts fitted coefficients; it is NULL where none are left. Constant residuals have NULL throughout.
    """
    w = Window.partitionBy(key).orderBy(ts)
    rows = _centred(residuals, key, ts).withColumns({f"_l{i}": F.lag("_e", i).over(w) for i in range(1, lags + 1)})
    sums = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("_e") * F.col("_e")).alias("_s"), *[F.sum(F.col("_e") * F.col(f"_l{i}")).alias(f"_c{i}") for i in range(1, lags + 1)]
    )
    cells = [F.struct(F.lit(i).alias("lag"), F.try_divide(f"_c{i}", F.nullif("_s", F.lit(0.0))).alias("r")) for i in range(1, lags + 1)]
    each = sums.select(key, "_n", F.inline(F.array(*cells))).filter(F.col("lag") < F.col("_n"))
    so_far = Window.partitionBy(key).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("_n") * (F.col("_n") + 2) * F.sum(F.col("r") * F.col("r") / (F.col("_n") - F.col("lag"))).over(so_far)
    each = each.withColumn("q", F.when(F.col("r").isNotNull(), q))
    used = F.lit(used) if isinstance(used, int) else used
    return each.select(key, "lag", "r", "q", chi_square_p("q", (F.col("lag") - used).cast("double")).alias("p_value"))


def normality(residuals: DataFrame, key: str, ts: str) -> DataFrame:
    """``(key, n, mean, spread, skewness, kurtosis, jarque_bera, p_value, spread_ratio)`` of each series.

    Skewness and kurtosis are the ratios of population moments (a normal has 0 and 3). ``spread_ratio`` is the sum of
    squares of the last third over that of the first third: far from 1 where the spread changes with time.
    """
    rows = _centred(residuals, key, ts).withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(ts)))
    third = F.floor(F.count(F.lit(1)).over(Window.partitionBy(key)) / 3)
    n_rows = F.count(F.lit(1)).over(Window.partitionBy(key))
    square = F.col("residual") * F.col("residual")
    rows = rows.withColumns({"_early": F.when(F.col("_i") <= third, square), "_late": F.when(F.col("_i") > n_rows - third, square)})
    power = lambda k: F.avg(F.pow("_e", F.lit(float(k))))
    agg = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean"), power(2).alias("_m2"), power(3).alias("_m3"), power(4).alias("_m4"),
        F.try_divide(F.sum("_late"), F.sum("_early")).alias("spread_ratio"),
    )
    shaped = agg.withColumns({
        "spread": F.sqrt("_m2"),
        "skewness": F.try_divide("_m3", F.pow("_m2", F.lit(1.5))),
        "kurtosis": F.try_divide("_m4", F.pow("_m2", F.lit(2.0))),
    })
    shaped = shaped.withColumn("jarque_bera", F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + (F.col("kurtosis") - 3) * (F.col("kurtosis") - 3) / 4))
    # two degrees of freedom: the tail is an exponential
    return shaped.select(key, "n", "mean", "spread", "skewness", "kurtosis", "jarque_bera", F.exp(-F.col("jarque_bera") / 2).alias("p_value"), "spread_ratio")


def normal_scores(residuals: DataFrame, key: str, ts: str) -> DataFrame:
    """``(key, ts, standardised, place, score)``: points of a normal plot.

    ``place`` is ``(rank - 3/8) / (n + 1/4)`` of the residual in its series, ``score`` the normal quantile there.
    """
    rows = _centred(residuals, key, ts)
    whole = Window.partitionBy(key)
    spread = F.nullif(F.sqrt(F.avg(F.col("_e") * F.col("_e")).over(whole)), F.lit(0.0))
    rank = F.row_number().over(whole.orderBy("_e", ts))
    rows = rows.withColumns({"standardised": F.col("_e") / spread, "place": (rank - 0.375) / (F.count(F.lit(1)).over(whole) + 0.25)})
    return rows.select(key, ts, "standardised", "place", probit(F.col("place")).alias("score"))
