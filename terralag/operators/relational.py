"""Column, row and join operators with the reference rules for names, order and missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def drop_sparse_columns(df: DataFrame, limit: float = 0.2) -> DataFrame:
    """Drop columns whose share of NULLs is above ``limit``. The driver sees one row of shares."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if (shares[c] or 0.0) > limit])


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def within_time_range(df: DataFrame, time: str, other: DataFrame, other_time: str) -> DataFrame:
    """Rows whose ``time`` lies inside the other table's min and max, both ends included.

    The two bounds become literals, so the filter reaches the scan.
    """
    low, high = other.agg(F.min(other_time), F.max(other_time)).first()
    return df.filter(F.col(time).between(F.lit(low), F.lit(high)))


def after_day(df: DataFrame, day: str, first: str = "2004-01-06") -> DataFrame:
    """Rows from ``first`` on. The default is ``01-06-2004`` read month first: 6 January."""
    return df.filter(F.col(day) >= F.to_date(F.lit(first)))


def radius_counts(df: DataFrame, distance: str, radii: Sequence[int]) -> DataFrame:
    """How many rows each radius keeps, all radii in one pass."""
    return df.agg(*[F.count_if(F.col(distance) < r).alias(f"within_{r}") for r in radii])


def split_by_date(df: DataFrame, day: str, train_end: str, test_start: str, test_end: str):
    """(train, test); all ends included."""
    d = F.to_date(F.col(day))
    train = df.filter(d <= F.to_date(F.lit(train_end)))
    test = df.filter(d.between(F.to_date(F.lit(test_start)), F.to_date(F.lit(test_end))))
    return train, test


def suffix_join(
    left: DataFrame, right: DataFrame, on: str, how: str = "left", suffixes=("_x", "_y")
) -> DataFrame:
    """Join on ``on``; other names both sides have get the suffixes."""
    clash = [c for c in left.columns if c in right.columns and c != on]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return a.join(b, on, how)


def side_by_side(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows with the same ``on`` next to each other; a name ``left`` has wins over ``right``'s."""
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(on, *extra), on, "full")


def parameter_grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Each row with every combination of the given axes: one explode per axis, not a table join."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def best_row(df: DataFrame, score: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest ``score`` (then ``tie``), overall or per ``by``."""
    rest = [c for c in df.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.when(F.col(score).isNotNull(), F.struct(score, tie)))
    return df.groupBy(*by).agg(best.alias("_best")).select(*by, "_best.*")


def stage_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """``(stage, n_rows, n_columns)`` of several tables as one report."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("stage"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns")
        )
        for name, df in stages.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
