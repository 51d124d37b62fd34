"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and a proof per document.

A row's leaf is the SHA-256 of its fields, each length-prefixed. Leaves are numbered per source along the order of
their ids by a range-partitioned sort. Every level is one job over a staged table: nodes equijoin the same table on
computed sibling indices (``index XOR 1`` for two children, otherwise the slot offsets 1 to ``arity - 1`` round the run),
which gives each node the digests before and after it in its run, and the rows of slot zero emit the parents. Keys are
(tree, index), so no key repeats and a hot source spreads like any other; levels shrink by ``arity``. Going down again,
each level joins the steps of its parents by (tree, index div arity), so a leaf gets its whole proof.

Digests travel as 32 bytes; hash inputs are their lowercase hex texts. All of it is DataFrame functions.

Defined cases: a null field is ``-``; leaves ascend by doc_id with null first, equal ids by their leaves; a lone leaf
is its source's subroot and a lone subroot the root; a null source is a source and the first; an empty table gives an
empty result; columns besides the five fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import positions, stage, union_all

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
_STEPS = "array<struct<before:binary,after:binary>>"


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_text(fields: dict[str, Column]) -> Column:
    """The fields one after the other: ``-`` for null, otherwise byte count, colon, value."""
    texts = [c.cast("string") for c in fields.values()]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def leaves(rows: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, source, h, other)``: each row's leaf, and its leaf with ``changed`` fields."""
    own = {f: F.col(f) for f in FIELDS}
    return rows.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), digest(leaf_text(own)).alias("h"), digest(leaf_text(own | (changed or {}))).alias("other"))


def _sibling(arity: int, offset: int) -> str:
    """The index of the node ``offset`` slots further round the run of ``index``."""
    return "index ^ 1L" if arity == 2 else f"index - index % {arity} + (index + {offset}) % {arity}"


def with_steps(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """``nodes(tree, index, h, ...)`` with ``before`` and ``after``: the digests round each node in its run."""
    out = nodes
    for k in range(1, arity):
        near = nodes.selectExpr("tree", f"index AS _at{k}", f"h AS _h{k}")
        out = out.selectExpr("*", f"{_sibling(arity, k)} AS _at{k}").join(near, ["tree", f"_at{k}"], "left")
    part = lambda sign: ", ".join(f"IF(index % {arity} + {k} {sign} {arity} AND _h{k} IS NOT NULL, _h{k}, X'')" for k in range(1, arity))
    return out.selectExpr(*nodes.columns, f"concat({part('>=')}) AS before", f"concat({part('<')}) AS after")


def climb(nodes: DataFrame, most: int, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The levels with their steps, from the leaves up, and the nodes each tree ends in.

    ``nodes(tree, index, h, n, ...)``, with n the tree's number of nodes and ``most`` the largest; further columns
    stay on the first level. The ends have the level they were reached at.
    """
    levels, ends, level = [], [], 0
    while True:
        ends.append(nodes.where("n = 1").selectExpr("tree", "h", f"{level} AS level"))
        if most <= 1:
            return levels, union_all(ends)
        steps = stage(with_steps(nodes.where("n > 1"), arity), "level")
        levels.append(steps)
        parent = "unhex(sha2(concat(lower(hex(h)), lower(hex(after))), 256)) AS h"
        nodes = steps.where(f"index % {arity} = 0").selectExpr("tree", f"index div {arity} AS index", parent, f"(n + {arity - 1}) div {arity} AS n")
        most, level = -(-most // arity), level + 1


def descend(levels: list[DataFrame], ends: DataFrame, arity: int = ARITY) -> DataFrame:
    """The first level's nodes with ``steps``, their proof from the bottom up, and the columns of ``ends``.

    ``ends(tree, level, above, ...)`` has one row per tree; ``above`` are the steps past its end.
    """
    names = [c for c in ends.columns if c not in ("tree", "level", "above")]
    done = lambda level: ends.where(f"level = {level}").selectExpr("tree", "0L AS index", "above AS steps", *names)
    up, out = done(len(levels)), None
    for level in range(len(levels) - 1, -1, -1):
        parents = up.selectExpr("tree", "index AS _up", "steps AS _steps", *names)
        own = [c for c in levels[level].columns if c not in ("before", "after")] if level == 0 else ["tree", "index"]
        met = levels[level].selectExpr("*", f"index div {arity} AS _up").join(parents, ["tree", "_up"])
        out = met.selectExpr(*own, "concat(array(struct(before, after)), _steps) AS steps", *names)
        up = out.unionByName(done(level)) if level else out
    return out


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf's hex text and its steps."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(hex_text(s["before"]), h, hex_text(s["after"])), 256))


def proof_text(steps: Column) -> Column:
    """The siblings' digests, level by level from the leaf up, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(hex_text(s["before"]), hex_text(s["after"]))), "")


def manifest(rows: DataFrame, arity: int = ARITY, changed: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, source, leaf, other, subroot, root, steps)``, one row per row of ``rows``.

    ``other`` is the leaf with the ``changed`` fields; digests are 32 bytes, ``steps`` the proof from the leaf to the root.
    """
    # staged, so the range partitioning samples leaves and does not hash all texts twice
    placed = positions(stage(leaves(rows, changed), "hashed"), [F.col("source"), F.col("doc_id"), F.col("h")], "at")
    sources = placed.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    sources = stage(positions(sources, [F.col("source")], "tree"), "sources")
    own = sources.select(F.col("source").alias("_source"), "tree", "first", "n")
    met = placed.join(own, F.col("source").eqNullSafe(F.col("_source"))).withColumn("index", F.col("at") - F.col("first"))
    nodes = stage(met.select("tree", "index", "h", "n", "doc_id", "source", "other"), "leaves")

    size = sources.agg(F.count("*").alias("trees"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    levels, ends = climb(nodes, size.most, arity)
    subroots = stage(ends, "subroots")
    upper, top = climb(subroots.selectExpr("0L AS tree", "tree AS index", "h", f"{size.trees}L AS n"), size.trees, arity)
    end = top.select("tree", "level", F.col("h").alias("root"), F.array().cast(_STEPS).alias("above"))
    if upper:
        above = descend(upper, end, arity).select(F.col("index").alias("tree"), F.col("steps").alias("above"), "root")
    else:
        above = end.select(F.lit(0).cast("long").alias("tree"), "above", "root")
    ends = stage(subroots.select("tree", "level", F.col("h").alias("subroot")).join(above, "tree"), "roots")

    out = ["doc_id", "source", F.col("h").alias("leaf"), "other", "subroot", "root", "steps"]
    lone = nodes.where("n = 1").join(ends.withColumnRenamed("above", "steps"), "tree").select(*out)
    return descend(levels, ends, arity).select(*out).unionByName(lone) if levels else lone
