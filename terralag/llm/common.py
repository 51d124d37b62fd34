"""Helpers shared by the operators: bounded Arrow batches, staged tables, min-label components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralag.session import drop_path, new_path

#: Text handled at once inside a task; the arrays made from it are some tens of times as large.
SLICE_BYTES = 2 << 20
#: Up to so many undirected edges are settled by one task instead of a distributed loop.
LOCAL_EDGES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(tables: list[DataFrame]) -> None:
    """Delete what :func:`stage` wrote for ``tables``, once nothing reads them any more."""
    for df in tables:
        drop_path(df.sparkSession, df._staged_at)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes of text; a longer text is a slice by itself."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(size)], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def positions(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with the 0-based position of each row in ``order`` as ``name``.

    Rows are dealt by ranges of ``order`` and sorted where they are; what goes to one task is one count per
    partition. Rows that are equal in ``order`` may share a position's neighbourhood in any order.
    """
    at, part = free_name(df, "_at"), free_name(df, "_part")
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn(part, F.shiftright(at, 33))
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select(part, before.alias("_first"))
    out = placed.join(F.broadcast(first), part)  # one row per partition
    return out.select(*df.columns, (F.col("_first") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def _local_labels(frames):
    """Smallest reachable node of every node, for all edges of one task."""
    import pandas as pd

    parts = list(frames)
    if not parts:
        return
    edges = pd.concat(parts)
    nodes, at = np.unique(edges[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pd.DataFrame({"node": nodes, "label": nodes[label]})


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, label)``: the smallest node reachable from each.

    Alternating large-star and small-star rounds, each a min-aggregate and a join, end when no edge
    changes; every round is written to the shared folder. Nulls and loops are left out. When a count
    shows at most ``LOCAL_EDGES`` edges, one task settles them; the result is the same.
    """
    cur = edges.select("a", "b").where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
    cur = stage(cur, "edges")
    while True:
        if cur.count() <= LOCAL_EDGES:
            return cur.coalesce(1).mapInPandas(_local_labels, "node long, label long")
        both = cur.unionByName(cur.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").selectExpr("b a", "m b").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b a", "m b").where("a <> b")
        new = stage(small.unionByName(low.selectExpr("a", "m b")).distinct(), "edges")
        same = new.count() == cur.count() and new.exceptAll(cur).isEmpty()
        cur = new
        if same:
            stars = cur.selectExpr("a node", "b label")
            return stars.unionByName(cur.selectExpr("b node", "b label").distinct())
