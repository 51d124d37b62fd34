"""Exact nearest-neighbour joins.

Right-hand vectors are summarised in a hierarchy of grid cells (count and tight bounding box per
cell). Left-hand rows walk down the levels with equi-joins on the cell code, keeping only cells
whose lower distance bound does not exceed the best upper bound known for the row. A dense cell is
split further and never paired with all its rows; copies of a vector count once. All bounds use the
same monotone floating-point steps as the distance itself, so pruning cannot lose a neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from terralag.session import cut_lineage

LEAF_ROWS = 32
MAX_BITS = 48
BROADCAST_CELLS = 20_000
METRES_PER_DEGREE = 111_320


def distance_degrees(lat_a, lon_a, lat_b, lon_b) -> Column:
    """Euclidean distance in degrees."""
    return F.sqrt(F.pow(lat_a - lat_b, F.lit(2.0)) + F.pow(lon_a - lon_b, F.lit(2.0)))


def degrees_to_metres(c: Column) -> Column:
    return c * F.lit(float(METRES_PER_DEGREE))


def _add(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _scaled_norm(parts: list[Column], p: int) -> Column:
    """sqrt(p/m * sum of squares) over the m parts that are not NULL; NULL when m is 0."""
    squares = [F.coalesce(part * part, F.lit(0.0)) for part in parts]
    shared = _add([part.isNotNull().cast("int") for part in parts])
    return F.when(shared > 0, F.sqrt(F.lit(float(p)) / shared * _add(squares)))


class CellTree:
    """Grid-cell hierarchy over the distinct vectors of a table."""

    def __init__(self, rows: DataFrame, dims: Sequence[str], row_id: str, leaf_rows: int = LEAF_ROWS):
        self.dims = list(dims)
        self.bits = 2 if len(self.dims) <= 2 else 1
        any_value = reduce(lambda a, b: a | b, [F.col(d).isNotNull() for d in self.dims])
        # NaN-free doubles; -0.0 and 0.0 are one vector
        clean = rows.select(*[(F.col(d).cast("double") + F.lit(0.0)).alias(d) for d in self.dims], row_id)
        self.vectors = cut_lineage(
            clean.filter(any_value)
            .groupBy(*self.dims)
            .agg(F.min(row_id).alias("rid"), F.count(F.lit(1)).alias("copies"))
        )
        stats = self.vectors.agg(
            F.count(F.lit(1)),
            *[f(d) for d in self.dims for f in (F.min, F.max)],
        ).first()
        self.size = stats[0]
        if not self.size:
            return
        lows, highs = stats[1::2], stats[2::2]
        self.origin = [low if low is not None else 0.0 for low in lows]
        self.span = max([b - a for a, b in zip(lows, highs) if a is not None] + [0.0]) or 1.0
        max_level = MAX_BITS // self.bits
        # depth for evenly spread vectors; clustered ones get more levels below
        effective = self.bits * len(self.dims)
        last = min(max_level, max(1, math.ceil(math.log2(max(self.size / leaf_rows, 1)) / effective)))
        tables, first = [], 0
        self.level_sizes: dict[int, int] = {}
        while True:
            table = cut_lineage(self._levels(first, last))
            tables.append(table)
            fullest = 0
            for row in table.groupBy("level").agg(F.count(F.lit(1)), F.max("cnt")).collect():
                self.level_sizes[row[0]] = row[1]
                fullest = row[2] if row[0] == last else fullest
            if fullest <= 4 * leaf_rows or last >= max_level:
                break
            first = last + 1
            last = min(max_level, last + max(1, math.ceil(math.log2(fullest / leaf_rows) / effective)))
        self.depth = last
        self.cells = reduce(DataFrame.unionByName, tables)

    def _steps(self, level: int) -> list[Column]:
        """The cell of a vector at a level: one number per dimension, NULL where the vector has none."""
        scale = float(1 << level * self.bits)
        return [F.floor((F.col(d) - F.lit(o)) / F.lit(self.span) * F.lit(scale)) for d, o in zip(self.dims, self.origin)]

    @staticmethod
    def _code(steps: Sequence[Column]) -> Column:
        return F.concat_ws(":", *[F.coalesce(s.cast("string"), F.lit("-")) for s in steps])

    def _levels(self, first: int, last: int) -> DataFrame:
        """Cells of levels ``first`` to ``last``: vectors are grouped once, upper levels from those cells."""
        p = range(len(self.dims))
        steps = [s.cast("bigint").alias(f"k_{i}") for i, s in enumerate(self._steps(last))]
        leaves = self.vectors.groupBy(*steps).agg(
            F.sum("copies").alias("cnt"),
            *[F.min(d).alias(f"lo_{i}") for i, d in enumerate(self.dims)],
            *[F.max(d).alias(f"hi_{i}") for i, d in enumerate(self.dims)],
        )
        leaves = cut_lineage(leaves)
        rows = leaves.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(first, last + 1)])))
        up = lambda i, more: F.call_function("shiftright", F.col(f"k_{i}"), ((F.lit(last + more) - F.col("level")) * self.bits).cast("int"))
        rows = rows.withColumn("code", self._code([up(i, 0) for i in p])).withColumn(
            "parent", F.when(F.col("level") > 0, self._code([up(i, 1) for i in p]))
        )
        return rows.groupBy("level", "code", "parent").agg(
            F.sum("cnt").alias("cnt"), *[f(f"{n}_{i}").alias(f"{n}_{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in p]
        )

    def level(self, number: int) -> DataFrame:
        part = self.cells.filter(F.col("level") == number).drop("level")
        return F.broadcast(part) if self.level_sizes[number] <= BROADCAST_CELLS else part

    def leaves(self) -> DataFrame:
        return self.vectors.withColumn("code", self._code(self._steps(self.depth)))


def nearest_vectors(left: DataFrame, tree: CellTree, k: int = 1, need: str | None = None) -> DataFrame:
    """``(lid, [need], rid, copies, dist, v_0..)`` of the nearest vectors for each left row.

    ``left`` holds ``lid`` (unique with ``need``) and ``x_0..`` for the tree's dimensions. With
    ``need`` given, only vectors that are not NULL in dimension number ``need`` count. Vectors are
    returned, nearest first by ``(dist, rid)``, until ``k`` rows (copies included) are covered.
    """
    p = len(tree.dims)
    ids = ["lid"] + ([need] if need else [])
    xs = [F.col(f"x_{i}") for i in range(p)]
    keep = [*ids, *[f"x_{i}" for i in range(p)]]

    def bounds(df: DataFrame) -> DataFrame:
        gaps, fars = [], []
        for i in range(p):
            lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
            both = xs[i].isNotNull() & lo.isNotNull()
            gaps.append(F.when(both, F.greatest(lo - xs[i], xs[i] - hi, F.lit(0.0))))
            fars.append(F.when(both, F.greatest(F.abs(xs[i] - lo), F.abs(xs[i] - hi))))
        out = df.withColumns({"near": _scaled_norm(gaps, p), "far": _scaled_norm(fars, p)})
        if need:
            has = F.array(*[F.col(f"lo_{i}").isNotNull() for i in range(p)])
            out = out.filter(F.element_at(has, F.col(need) + 1))
        return out.filter(F.col("near").isNotNull())

    def prune(df: DataFrame) -> DataFrame:
        row = Window.partitionBy(*ids)
        if k == 1:
            best = F.min("far").over(row)
            kept = df.withColumn("limit", best)
        else:
            covered = F.sum("cnt").over(row.orderBy("far"))
            kept = df.withColumn("covered", covered).withColumn(
                "limit",
                F.coalesce(F.min(F.when(F.col("covered") >= k, F.col("far"))).over(row), F.lit(math.inf)),
            )
        return kept.filter(F.col("near") <= F.col("limit")).select(*keep, "code", "limit")

    # level 0 has one cell per pattern of missing dimensions
    roots = tree.cells.filter("level = 0").collect()
    fields = ["code", "cnt", *[f"lo_{i}" for i in range(p)], *[f"hi_{i}" for i in range(p)]]
    kinds = {"code": "string", "cnt": "bigint"}
    literal = F.array(
        *[
            F.struct(*[F.lit(root[f]).cast(kinds.get(f, "double")).alias(f) for f in fields])
            for root in roots
        ]
    )
    cand = left.select(*keep).repartition(*ids).select(*keep, F.inline(literal))
    cand = prune(bounds(cand))
    for number in range(1, tree.depth + 1):
        cells = tree.level(number).withColumnRenamed("code", "child")
        step = cand.join(cells, cand["code"] == cells["parent"]).drop("code", "parent")
        step = bounds(step.withColumnRenamed("child", "code")).filter(F.col("near") <= F.col("limit"))
        cand = prune(step)
    leaves = tree.leaves().withColumnsRenamed({d: f"v_{i}" for i, d in enumerate(tree.dims)})
    if tree.size <= BROADCAST_CELLS:
        leaves = F.broadcast(leaves)
    pairs = cand.join(leaves, "code")
    diffs = [F.abs(F.col(f"x_{i}") - F.col(f"v_{i}")) for i in range(p)]
    pairs = pairs.withColumn("dist", _scaled_norm(diffs, p)).filter(F.col("dist") <= F.col("limit"))
    values = [f"v_{i}" for i in range(p)]
    if k == 1:
        best = F.min_by(F.struct("rid", "copies", "dist", *values), F.struct("dist", "rid"))
        return pairs.groupBy(*ids).agg(best.alias("best")).select(*ids, "best.*")
    # the leaves of the surviving cells hold the k nearest, so this window is short
    taken = F.coalesce(
        F.sum("copies").over(
            Window.partitionBy(*ids).orderBy("dist", "rid").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    return (
        pairs.withColumn("taken", taken)
        .filter(F.col("taken") < k)
        .select(*ids, "rid", F.least("copies", F.lit(k) - F.col("taken")).alias("copies"), "dist", *values)
    )


def merge_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns of ``right`` that ``left`` does not have: the first of a duplicate name wins."""
    return [c for c in right.columns if c not in left.columns]


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    left_xy: tuple[str, str],
    right_xy: tuple[str, str],
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Each left row with its nearest right row and ``distance``; ties go to the lowest right id.

    Columns of ``right`` whose name ``left`` already has are dropped. Left rows without coordinates,
    or all of them when ``right`` is empty, keep NULLs.
    """
    extra = merge_columns(left, right)
    sites = right.select(
        F.col(right_id).alias("site"), *[F.col(c).cast("double").alias(d) for c, d in zip(right_xy, "ab")]
    ).filter("a IS NOT NULL AND b IS NOT NULL")
    tree = CellTree(sites, ["a", "b"], "site", leaf_rows)
    if not tree.size:
        kinds = {f.name: f.dataType for f in right.schema.fields}
        return left.withColumns(
            {**{c: F.lit(None).cast(kinds[c]) for c in extra}, "distance": F.lit(None).cast("double")}
        )
    probes = left.select(
        F.col(left_id).alias("lid"),
        *[F.col(c).cast("double").alias(f"x_{i}") for i, c in enumerate(left_xy)],
    ).filter("x_0 IS NOT NULL AND x_1 IS NOT NULL")
    match = nearest_vectors(probes, tree).select(
        F.col("lid").alias("_lid"), F.col("rid").alias("_rid"), F.col("dist").alias("distance")
    )
    payload = right.select(F.col(right_id).alias("_pid"), *extra)
    found = match.join(payload, F.col("_rid") == F.col("_pid")).drop("_rid", "_pid")
    return left.join(found, left[left_id] == found["_lid"], "left").drop("_lid")


def grid_snap_join(
    points: DataFrame,
    raster: DataFrame,
    point_id: str,
    pixel_id: str,
    point_xy: tuple[str, str],
    pixel_xy: tuple[str, str],
    x0: float,
    y0: float,
    res: float,
    row_col: tuple[str, str] = ("row", "col"),
) -> DataFrame:
    """:func:`nearest_join` for a raster whose pixels sit at ``x0 - row*res, y0 + col*res``.

    One equi-join on the 3x3 block around the snapped cell. A hit is final when nothing outside the
    block can be as near; the other points (raster holes, points off the raster) go to
    :func:`nearest_join`.
    """
    extra = merge_columns(points, raster)
    row, col = row_col
    px, py = (F.col(c).cast("double") for c in point_xy)
    probes = points.select(F.col(point_id).alias("_lid"), px.alias("_x"), py.alias("_y")).withColumns(
        {
            "_r": F.round((F.lit(x0) - F.col("_x")) / F.lit(res)).cast("bigint"),
            "_c": F.round((F.col("_y") - F.lit(y0)) / F.lit(res)).cast("bigint"),
        }
    )
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    block = probes.withColumn("_o", F.explode(around)).select(
        "_lid", "_x", "_y", (F.col("_r") + F.col("_o.i")).alias("_kr"), (F.col("_c") + F.col("_o.j")).alias("_kc")
    )
    # the block goes to the pixels as they are: at most nine cells a point are kept, then grouped by point
    cells = raster.select(
        F.col(row).cast("bigint").alias("_kr"),
        F.col(col).cast("bigint").alias("_kc"),
        *[F.col(c).cast("double").alias(n) for c, n in zip(pixel_xy, ("_px", "_py"))],
        F.col(pixel_id).alias("_rid"),
    )
    if points.count() * 9 <= BROADCAST_CELLS:
        block = F.broadcast(block)
    dist = distance_degrees(F.col("_px"), F.col("_py"), F.col("_x"), F.col("_y"))
    best = (
        block.join(cells, ["_kr", "_kc"])
        .withColumn("_d", dist)
        .groupBy("_lid")
        .agg(F.min_by(F.struct(F.col("_d").alias("d"), F.col("_rid").alias("r")), F.struct("_d", "_rid")).alias("_b"))
    )
    # pixels outside the block are at least 1.5 cells away; the margin covers rounding of coordinates
    hits = cut_lineage(best.filter(F.col("_b.d") < F.lit(1.49 * res)))
    payload = raster.select(F.col(pixel_id).alias("_pid"), *extra)
    found = (
        hits.select("_lid", F.col("_b.r").alias("_rid"), F.col("_b.d").alias("distance"))
        .join(payload, F.col("_rid") == F.col("_pid"))
        .drop("_rid", "_pid")
    )
    done = points.join(found, points[point_id] == found["_lid"], "inner").drop("_lid")
    rest = points.join(hits.select("_lid"), points[point_id] == F.col("_lid"), "left_anti")
    if rest.isEmpty():
        return done
    return done.unionByName(nearest_join(rest, raster, point_id, pixel_id, point_xy, pixel_xy))
