"""Exact interpolated quantiles that never hold a whole column in one task."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from terralag.session import cut_lineage

EXACT_LIMIT = 1_000_000  # distinct values one task may sort
PERCENTILE_LIMIT = 200_000  # rows up to which the built-in aggregate is the cheaper way
_ACCURACY = 100_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str] | Mapping[str, Column],
    probs: Sequence[float],
    limit: int = EXACT_LIMIT,
    rows_at_most: int | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, NULLs left out.

    Columns of up to ``min(limit, PERCENTILE_LIMIT)`` rows take one ``percentile`` aggregate. Larger ones take a count and
    two scans for all columns and quantiles together, see :func:`_order_statistics`. A known bound on the
    number of rows (``rows_at_most``) can save the counting pass.
    """
    exprs = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    if not exprs:
        return {}
    exprs = {name: c.cast("double") for name, c in exprs.items()}
    names = list(exprs)
    small = min(limit, PERCENTILE_LIMIT)
    if rows_at_most is not None and rows_at_most <= small:
        counts = [rows_at_most] * len(names)
    else:
        counts = list(df.agg(*[F.count(exprs[n]).alias(str(i)) for i, n in enumerate(names)]).first())
    sizes = dict(zip(names, counts))
    out: dict[str, list[float | None]] = {n: [None] * len(probs) for n in names if not sizes[n]}
    tiny = [n for n in names if 0 < sizes[n] <= small]
    if tiny:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(exprs[n], levels).alias(str(i)) for i, n in enumerate(tiny)]).first()
        for i, n in enumerate(tiny):
            out[n] = list(row[i]) if row[i] is not None else [None] * len(probs)
    large = [n for n in names if n not in out]
    if large:
        spots = {n: [(sizes[n] - 1) * p for p in probs] for n in large}
        ranks = {n: sorted({f(h) for h in spots[n] for f in (math.floor, math.ceil)}) for n in large}
        found = _order_statistics(df, {n: exprs[n] for n in large}, sizes, ranks, limit)
        for n in large:
            ends = [(found[n][math.floor(h)], found[n][math.ceil(h)], h - math.floor(h)) for h in spots[n]]
            out[n] = [low + (high - low) * share for low, high, share in ends]
    return {n: out[n] for n in names}


def _order_statistics(df, exprs, sizes, ranks, limit) -> dict[object, dict[int, float]]:
    """The values at the wanted ``ranks`` (0-based) of each column; NULLs don't count.

    Scan one: sketches give two cuts around every rank. Scan two: rows between cuts, from which follows the gap that holds
    a rank, and the values in the gaps between two cuts of a rank, counted. If a rank lies elsewhere, one more scan counts the
    values there. The values are ordered per gap.
    A value that is a cut has a gap of its own. A gap with more than ``limit`` distinct values becomes a
    column of the next round, which holds some ten-thousandth of its rows.
    """
    names = list(exprs)
    base = df.select(*[exprs[n].alias(f"v{i}") for i, n in enumerate(names)])
    slack = 2.0 / _ACCURACY
    levels = []
    for n in names:
        spread = [r / max(sizes[n] - 1, 1) for r in ranks[n]]
        levels.append(sorted({min(max(p + s, 0.0), 1.0) for p in spread for s in (-slack, slack)}))
    row = base.agg(*[F.percentile_approx(f"v{i}", p, _ACCURACY).alias(str(i)) for i, p in enumerate(levels)]).first()
    cuts = [sorted({x for c in row[i] for x in (c, math.nextafter(c, math.inf))} - {math.inf}) for i in range(len(names))]
    cut = Bucketizer(
        splitsArray=[[-math.inf, *c, math.inf] for c in cuts],
        inputCols=[f"v{i}" for i in range(len(names))],
        outputCols=[f"g{i}" for i in range(len(names))],
        handleInvalid="keep",
    )
    marked = cut.transform(base)
    likely = [set() for _ in names]
    for i, n in enumerate(names):
        at = dict(zip(levels[i], row[i]))
        for p in (r / max(sizes[n] - 1, 1) for r in ranks[n]):
            low, high = at[max(p - slack, 0.0)], at[min(p + slack, 1.0)]
            spots = range(max(bisect_right(cuts[i], low), 1), min(bisect_left(cuts[i], high) + 1, len(cuts[i])))
            likely[i] |= {g for g in spots if cuts[i][g] != math.nextafter(cuts[i][g - 1], math.inf)}
    cells = [
        F.struct(
            F.lit(i).alias("c"),
            F.col(f"g{i}").cast("int").alias("g"),
            F.col(f"v{i}").alias("v"),
            (F.col(f"g{i}").isin(sorted(likely[i])) if likely[i] else F.lit(False)).alias("inside"),
        )
        for i in range(len(names))
    ]
    rows = marked.select(F.inline(F.filter(F.array(*cells), lambda s: s["v"].isNotNull())))
    counted = cut_lineage(rows.groupBy("c", "g", F.when(F.col("inside"), F.col("v")).alias("v")).agg(F.count("*").alias("count")))
    gaps: list[dict] = [{} for _ in names]
    for r in counted.groupBy("c", "g").agg(F.sum("count").alias("n"), F.count("v").alias("kinds")).collect():
        gaps[r["c"]][r["g"]] = (r["n"], r["kinds"])
    out: dict[object, dict[int, float]] = {n: {} for n in names}
    held: dict[tuple[int, int], list] = {}
    for i, n in enumerate(names):
        order = sorted(gaps[i])
        upto = list(accumulate(gaps[i][g][0] for g in order))
        for rank in ranks[n]:
            at = bisect_right(upto, rank)
            g, before = order[at], upto[at - 1] if at else 0
            if 0 < g < len(cuts[i]) and cuts[i][g] == math.nextafter(cuts[i][g - 1], math.inf):
                out[n][rank] = cuts[i][g - 1]
            else:
                held.setdefault((i, g), []).append((rank, rank - before))
    if any(g not in likely[i] for i, g in held):
        # a sketch was off: one more scan for the gaps that hold a rank
        wanted = df.sparkSession.createDataFrame(list(held), "c int, g int")
        counted = cut_lineage(rows.join(F.broadcast(wanted), ["c", "g"]).groupBy("c", "g", "v").agg(F.count("*").alias("count")))
        for r in counted.groupBy("c", "g").agg(F.sum("count").alias("n"), F.count("v").alias("kinds")).collect():
            gaps[r["c"]][r["g"]] = (r["n"], r["kinds"])
    small = [(*key, *pair) for key, pairs in held.items() if gaps[key[0]][key[1]][1] <= limit for pair in pairs]
    large = {key: pairs for key, pairs in held.items() if gaps[key[0]][key[1]][1] > limit}
    counted = counted.filter("v IS NOT NULL")
    if small:
        wanted = df.sparkSession.createDataFrame(small, "c int, g int, rank long, local long")
        values = counted.join(F.broadcast(wanted.select("c", "g").distinct()), ["c", "g"])
        running = F.sum("count").over(Window.partitionBy("c", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        hits = values.withColumn("upto", running).join(F.broadcast(wanted), ["c", "g"])
        for r in hits.filter((F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("count"))).collect():
            out[names[r["c"]]][r["rank"]] = r["v"]
    if large:
        # staged: the rows of these gaps only, one column and one value each, so the next round is as small as they are
        keys = list(large)
        inside = df.sparkSession.createDataFrame([(*key, j) for j, key in enumerate(keys)], "c int, g int, k int")
        rest = counted.join(F.broadcast(inside), ["c", "g"]).select("k", "v", F.explode(F.array_repeat(F.lit(0), F.col("count").cast("int"))))
        rest = cut_lineage(rest.select("k", "v"))
        inner = {key: F.when(F.col("k") == j, F.col("v")) for j, key in enumerate(keys)}
        found = _order_statistics(
            rest, inner, {k: gaps[k[0]][k[1]][0] for k in large}, {k: sorted({x for _, x in v}) for k, v in large.items()}, limit
        )
        for key, pairs in large.items():
            for rank, local in pairs:
                out[names[key[0]]][rank] = found[key][local]
    return out
