"""Calendar and sequence operators on keyed series.

Raw rows are reduced to one row per key and month before any per-key window, so the length of a
window is bounded by the calendar whatever the number of rows. Operators that must see raw rows in
order use :mod:`terralag.operators.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from terralag.functions.scalars import month_end, next_month_start
from terralag.operators.ordered import fill_both_ways, previous_row


def daily_mean(df: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day"), *keys).agg(F.avg(value).alias(value))


def monthly_mean(df: DataFrame, ts: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, month_end(F.col(ts)).alias("month_end")).agg(*[F.avg(v).alias(v) for v in values])


def monthly_std(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Sample standard deviation per month; a month with one row has none."""
    return df.groupBy(*keys, month_end(F.col(ts)).alias("month_end")).agg(F.stddev_samp(value).alias(out or value))


def pivot_ratio(df: DataFrame, ts: str, key: str, value: str, top: str, bottom: str, names: Sequence[str]) -> DataFrame:
    """Mean per date with one column per name in ``names``, and ``ratio_percent`` = top/bottom*100."""
    wide = df.groupBy(ts).pivot(key, list(names)).agg(F.avg(value))
    ratio = F.try_divide(F.col(f"`{top}`"), F.col(f"`{bottom}`")) * 100
    return wide.withColumn("ratio_percent", ratio)


def fill_missing(
    df: DataFrame, columns: Sequence[str], order: str, keys: Sequence[str] = (), tie: str | None = None, **buckets: int
) -> DataFrame:
    """Forward then backward fill. Without ``keys`` it runs over the whole order of the table."""
    return fill_both_ways(df, columns, order, keys, tie, **buckets)


def percent_change(
    df: DataFrame, value: str, order: str, keys: Sequence[str] = (), tie: str | None = None, out: str = "change", **buckets: int
) -> DataFrame:
    """``value / previous value - 1``; keyed by default, whole-table order without ``keys``."""
    prev = previous_row(df, [value], order, keys, tie, **buckets)
    ratio = F.try_divide(F.col(value), F.col(f"prev_{value}")) - 1
    return prev.withColumn(out, ratio).drop(f"prev_{value}")


def monthly_volatility(
    df: DataFrame, ts: str, value: str, key: str, order: str, scope: str = "key", tie: str | None = None
) -> DataFrame:
    """``(key, month_end, volatility)``: monthly standard deviation of row-to-row changes.

    ``scope="file"`` takes changes over the whole table order, across keys, as the scripts do.
    """
    keys = [key] if scope == "key" else []
    changes = percent_change(df, value, order, keys, tie)
    return monthly_std(changes, ts, "change", [key], "volatility")


def month_end_series(df: DataFrame, ts: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Monthly means with a NULL row for each month missing between a key's first and last month."""
    means = monthly_mean(df, ts, values, keys)
    # the calendar is one row per key; exploding it costs no join of keys and months
    span = means.groupBy(*keys).agg(F.min("month_end").alias("a"), F.max("month_end").alias("b"))
    months = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))
    starts = span.filter("a IS NOT NULL").select(*keys, F.explode(months).alias("_month"))
    calendar = starts.select(*keys, F.last_day("_month").alias("month_end"))
    return calendar.join(means, [*keys, "month_end"], "left")


def move_to_next_month(df: DataFrame, month: str, out: str = "data") -> DataFrame:
    return df.withColumn(out, next_month_start(F.col(month)))


def lag_table(panel: DataFrame, key: str, ts: str, value: str, lags: int = 3) -> DataFrame:
    """``(key, ts, target, lag_1..lag_k)`` without incomplete rows."""
    w = Window.partitionBy(key).orderBy(ts)
    return panel.select(
        key, ts, F.col(value).alias("target"), *[F.lag(value, i).over(w).alias(f"lag_{i}") for i in range(1, lags + 1)]
    ).dropna(subset=["target", *[f"lag_{i}" for i in range(1, lags + 1)]])


def difference(panel: DataFrame, key: str, ts: str, value: str, out: str = "diff") -> DataFrame:
    w = Window.partitionBy(key).orderBy(ts)
    return panel.withColumn(out, F.col(value) - F.lag(value).over(w)).dropna(subset=[out])


def last_rows(panel: DataFrame, key: str, ts: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return panel.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def align_to(panel: DataFrame, other: DataFrame, key: str, ts: str, column: str) -> DataFrame:
    """``other``'s column on ``panel``'s dates (exact match first), then carried forward per key.

    Rows of ``other`` on dates ``panel`` lacks are dropped before the carry: not an as-of join.
    """
    on = [key, ts] if key in other.columns else [ts]
    joined = panel.join(other.select(*on, column), on, "left")
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(column, F.last(column, ignorenulls=True).over(w))


def fill_panel(panel: DataFrame, key: str, ts: str, column: str) -> DataFrame:
    """Forward then backward fill inside each (monthly, so short) series."""
    w = Window.partitionBy(key).orderBy(ts)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return panel.withColumn(
        column,
        F.coalesce(F.last(column, ignorenulls=True).over(before), F.first(column, ignorenulls=True).over(whole)),
    )


def decompose(panel: DataFrame, ts: str, value: str, keys: Sequence[str] = (), period: int = 12) -> DataFrame:
    """Additive decomposition: ``position, trend, seasonal, resid`` per series, NULLs removed first.

    Trend is the centred moving mean of length ``period`` (half weights at both ends when even),
    NULL at the edges; seasonal is the phase mean of the detrended values, centred on zero.
    """
    rows = panel.filter(F.col(value).isNotNull())
    order = Window.partitionBy(*keys).orderBy(ts)
    half = period // 2
    frame = order.rowsBetween(-half, half)
    width = 2 * half + 1
    total = F.sum(value).over(frame)
    if period % 2 == 0:
        total = total - (F.lag(value, half).over(order) + F.lead(value, half).over(order)) / 2
    full = F.count(value).over(frame) == width
    base = rows.withColumns(
        {
            "position": (F.row_number().over(order) - 1).cast("bigint"),
            "trend": F.when(full, total / F.lit(float(period))),
        }
    )
    base = base.withColumn("_phase", F.col("position") % period)
    by_phase = Window.partitionBy(*keys, "_phase")
    base = base.withColumn("_mean", F.avg(F.col(value) - F.col("trend")).over(by_phase))
    # mean of the phase means: each phase counts once
    first = F.when(F.col("position") < period, F.col("_mean"))
    base = base.withColumn("seasonal", F.col("_mean") - F.avg(first).over(Window.partitionBy(*keys)))
    return base.withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_phase", "_mean")


def expanding_folds(panel: DataFrame, key: str, ts: str, n_splits: int = 5) -> DataFrame:
    """Each row once per fold that uses it, with ``fold`` (0-based) and ``part`` train or val.

    The last ``n_splits`` blocks of ``n div (n_splits+1)`` rows validate; all earlier rows train.
    """
    w = Window.partitionBy(key)
    pos = F.row_number().over(w.orderBy(ts)) - 1
    size = F.floor(F.count(F.lit(1)).over(w) / (n_splits + 1))
    rows = panel.withColumns({"_pos": pos, "_size": size, "_n": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("_n") - (F.lit(n_splits) - F.col("fold")) * F.col("_size")
    part = F.when(F.col("_pos") < start, "train").when(F.col("_pos") < start + F.col("_size"), "val")
    return (
        rows.withColumn("part", part)
        .filter(F.col("part").isNotNull())
        .withColumn("fold", F.col("fold").cast("bigint"))
        .drop("_pos", "_size", "_n")
    )


def naive_forecasts(panel: DataFrame, key: str, ts: str, value: str, period: int = 12) -> DataFrame:
    """Adds ``seasonal_naive`` (value one period back) and ``last_value`` (value one step back)."""
    w = Window.partitionBy(key).orderBy(ts)
    return panel.withColumns(
        {"seasonal_naive": F.lag(value, period).over(w), "last_value": F.lag(value, 1).over(w)}
    )
