"""Sequence operators over orders too long for one task.

A plain ``Window.orderBy`` without partition keys, or with a key that holds a third of the rows,
puts an unbounded sequence into one task. Here the order is first cut into value buckets of
bounded size. A window then works inside ``(keys, bucket)`` and what crosses a bucket edge is one
carry row per ``(keys, bucket)``. A table of at most ``rows_per_bucket`` rows needs no cut: then a
plain window is already bounded.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BUCKET = 1_000_000
LEVEL_BUCKETS = 4096  # buckets that one pass cuts; more take a second pass inside them


def _as_number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    return c.cast("double")


def bucket_splits(df: DataFrame, value: Column, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Inner bucket edges for ``value``. A value that is an edge twice gets a bucket of its own."""
    n = df.agg(F.count(value)).first()[0]
    wanted = math.ceil(n / rows_per_bucket)
    if wanted <= 1:
        return []
    first = min(wanted, LEVEL_BUCKETS)
    edges = df.agg(F.percentile_approx(value, [i / first for i in range(1, first)], 10 * LEVEL_BUCKETS)).first()[0] if first > 1 else []
    inner = math.ceil(wanted / first)
    if inner > 1:
        # the driver holds one number per bucket, and buckets are of a fixed size
        probs = [i / inner for i in range(1, inner)]
        cut = _bucketize(df.select(value.alias("_v")), "_v", sorted(set(edges)), "_bucket")
        finer = cut.groupBy("_bucket").agg(F.percentile_approx("_v", probs, 10 * LEVEL_BUCKETS).alias("e")).collect()
        edges = sorted([*edges, *(e for r in finer for e in r["e"] or ())])
    splits: list[float] = []
    for edge in edges:
        if not splits or edge > splits[-1]:
            splits.append(edge)
        elif edge == splits[-1]:
            splits.append(math.nextafter(edge, math.inf))
    return splits


def with_bucket(
    df: DataFrame,
    order: str,
    out: str = "_bucket",
    tie: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    splits: list[float] | None = None,
) -> DataFrame:
    """Add ``out``: an integer that never decreases along ``(order, tie)``.

    Where one ``order`` value fills whole buckets by itself, its rows are cut again by ``tie``.
    Edges already known (:func:`bucket_splits`) save the pass that finds them.
    """
    value = _as_number(df, order)
    if splits is None:
        splits = bucket_splits(df, value, rows_per_bucket)
    if not splits:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    hot = [a for a, b in zip(splits, splits[1:]) if b == math.nextafter(a, math.inf)]
    cut = _bucketize(df.withColumn("_v", value), "_v", splits, out)
    if hot and tie:
        tie_value = _as_number(df, tie)
        hot_rows = cut.filter(F.col("_v").isin(hot))
        sub = bucket_splits(hot_rows, tie_value, rows_per_bucket)
        if sub:
            cut = _bucketize(cut.withColumn("_t", tie_value), "_t", sub, "_sub").drop("_t")
            width = len(sub) + 1
            cut = cut.withColumn(
                out, F.col(out) * width + F.when(F.col("_v").isin(hot), F.col("_sub")).otherwise(0)
            ).drop("_sub")
    return cut.drop("_v")


def _bucketize(df: DataFrame, column: str, splits: list[float], out: str) -> DataFrame:
    edges = [-math.inf, *splits, math.inf]
    cut = Bucketizer(splits=edges, inputCol=column, outputCol="_b", handleInvalid="keep").transform(df)
    return cut.withColumn(out, F.coalesce(F.col("_b"), F.lit(-1.0)).cast("bigint")).drop("_b")


def _join_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` where NULL keys match each other; a bucket is never NULL."""
    renamed = carry.withColumnsRenamed({k: f"_c_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        # plain equality lets the join read what a window by bucket has dealt
        cond = cond & (df[k] == renamed[f"_c_{k}"] if k == "_bucket" else df[k].eqNullSafe(renamed[f"_c_{k}"]))
    return df.join(renamed, cond, "left").drop(*[f"_c_{k}" for k in keys])


def previous_row(
    df: DataFrame,
    columns: Sequence[str],
    order: str,
    keys: Sequence[str] = (),
    tie: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``prev_<c>`` for each column: the value one row earlier in ``(order, tie)``."""
    at = [order] + ([tie] if tie else [])
    splits = bucket_splits(df, _as_number(df, order), rows_per_bucket)
    if not splits:
        w = Window.partitionBy(*keys).orderBy(*at)
        return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})
    cut = with_bucket(df, order, tie=tie, rows_per_bucket=rows_per_bucket, splits=splits)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*at)
    payload = F.struct(*columns)
    last = cut.groupBy(*keys, "_bucket").agg(F.max_by(payload, F.struct(*at)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carry = last.withColumn("_carry", F.lag("_last").over(across)).drop("_last")
    local = cut.withColumns(
        {"_prev": F.lag(payload).over(inside), "_first": F.row_number().over(inside) == 1}
    )
    joined = _join_carry(local, carry, [*keys, "_bucket"])
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    out = joined.withColumn("_before", before).withColumns(
        {f"prev_{c}": F.col(f"_before.{c}") for c in columns}
    )
    return out.drop("_bucket", "_prev", "_first", "_carry", "_before")


def fill_both_ways(
    df: DataFrame,
    columns: Sequence[str],
    order: str,
    keys: Sequence[str] = (),
    tie: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Forward fill, then backward fill what is left at the start."""
    names = [order] + ([tie] if tie else [])
    splits = bucket_splits(df, _as_number(df, order), rows_per_bucket)
    if not splits:
        w = Window.partitionBy(*keys).orderBy(*names)
        before = w.rowsBetween(Window.unboundedPreceding, 0)
        # only leading gaps are left after the carry, and those take the first value of the sequence;
        # a frame from the current row to the end would cost quadratic time
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns(
            {
                c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(whole))
                for c in columns
            }
        )
    cut = with_bucket(df, order, tie=tie, rows_per_bucket=rows_per_bucket, splits=splits)
    at = F.struct(*names)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    seen = {c: F.when(F.col(c).isNotNull(), at) for c in columns}
    edge = cut.groupBy(*keys, "_bucket").agg(
        *[F.max_by(c, seen[c]).alias(f"_last_{c}") for c in columns],
        *[F.min_by(c, seen[c]).alias(f"_head_{c}") for c in columns],
    )
    ordered = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = edge.select(
        *keys,
        "_bucket",
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns],
        *[F.first(f"_head_{c}", ignorenulls=True).over(whole).alias(f"_start_{c}") for c in columns],
    )
    local = cut.withColumns(
        {f"_local_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns}
    )
    joined = _join_carry(local, carry, [*keys, "_bucket"])
    filled = joined.withColumns(
        {c: F.coalesce(f"_local_{c}", f"_carry_{c}", f"_start_{c}") for c in columns}
    )
    return filled.select(*df.columns)


def running_total(
    df: DataFrame,
    value: str,
    order: str,
    out: str,
    keys: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    splits: list[float] | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows strictly before this one in ``(order, tie)``."""
    return running_totals(df, {out: value}, order, keys, rows_per_bucket, splits, tie)


def running_totals(
    df: DataFrame,
    totals: Mapping[str, str],
    order: str,
    keys: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    splits: list[float] | None = None,
    tie: str | None = None,
) -> DataFrame:
    """:func:`running_total` of several columns (``{out: value}``) over one sort."""
    at = [order] + ([tie] if tie else [])
    if splits is None:
        splits = bucket_splits(df, _as_number(df, order), rows_per_bucket)
    if not splits:
        w = Window.partitionBy(*keys).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({out: F.coalesce(F.sum(value).over(w), F.lit(0)) for out, value in totals.items()})
    cut = with_bucket(df, order, tie=tie, rows_per_bucket=rows_per_bucket, splits=splits)
    numbered = list(enumerate(totals.values()))
    sums = cut.groupBy(*keys, "_bucket").agg(*[F.sum(value).alias(f"_sum{i}") for i, value in numbered])
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(f"_sum{i}").over(across), F.lit(0)).alias(f"_base{i}") for i, _ in numbered]
    carry = sums.select(*keys, "_bucket", *bases)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({f"_local{i}": F.coalesce(F.sum(value).over(inside), F.lit(0)) for i, value in numbered})
    joined = _join_carry(local, carry, [*keys, "_bucket"])
    done = joined.withColumns({out: F.col(f"_base{i}") + F.col(f"_local{i}") for i, out in enumerate(totals)})
    return done.drop("_bucket", *[f"{part}{i}" for i, _ in numbered for part in ("_base", "_local")])


def row_position(
    df: DataFrame,
    order: str,
    out: str = "position",
    keys: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    tie: str | None = None,
) -> DataFrame:
    """Add ``out``: the 0-based position of each row in ``(order, tie)``, per ``keys``."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(ones, "_one", order, out, keys, rows_per_bucket, tie=tie).drop("_one")
