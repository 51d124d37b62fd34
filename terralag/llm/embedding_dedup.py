"""Near-duplicate vectors by NN-descent over a distributed neighbour graph.

Equal vectors become one with a weight. A forest of random hyperplanes gives first neighbours: vectors with
equal signs share a leaf, and leaves are cut by a hash into blocks of about ``LEAF`` rows. Then rounds join
neighbours of neighbours: all vectors that name a vector, or that it names, meet in a block of about ``BLOCK``
members; pairs with a new edge are measured, and a pair travels on only if it enters one of the two lists. Lists
that are saturated, with every entry at the threshold or above, are enlarged up to ``MOST`` entries. Rounds end
when few entries change.

No pair that was measured at the threshold or above is forgotten, whether or not a list has room for it: each block
also emits, for each of its members, a star to the smallest member it is connected to there, and the stars stay with
the graph. Components are those of the lists' edges and the stars. An audit then measures all vectors against a
fixed number of drawn ones, and counts the drawn ones that have all their links inside their component; while their
share is below ``target`` another forest is added and rounds go on. If ``ATTEMPTS`` forests do not reach it, the job fails and
says so. Inside components all pairs are counted, blockwise and without emitting pairs, so link counts have no gap
that comes from the length of lists. Cosines are taken in double precision.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing
and are their own component; so are rows with a null vec_id, which are kept as one row; vectors of
different lengths never link; a vec_id that repeats counts once, with the vector that sorts first; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import components, stage, unstage

LEAF, BLOCK, TABLES, LIST, MOST = 96, 64, 12, 12, 48
ROUNDS, CHANGED, ATTEMPTS, AUDIT, PAIR_BLOCK = 3, 0.01, 10, 512, 1024
#: Edges with this in place of a cosine are stars between connected members of a block.
STAR = 9.0
_EDGES = "a long, b long, s double"


def usable_vectors(table: DataFrame) -> DataFrame:
    """``(vec_id, v, h, h2)``: one row per vec_id with a usable vector, and 128 bits of hash of the vector."""
    one = table.groupBy("vec_id").agg(F.min("embedding").alias("v")).where("vec_id is not null")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    # minus zero is zero
    one = one.where(F.col("v").isNotNull() & good).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float")))
    return one.select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("h2"))


def distinct_vectors(usable: DataFrame) -> DataFrame:
    """``(id, v, weight, h, h2)``: equal vectors once, under their smallest id; no list of ids is made."""
    return usable.groupBy("h", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("id"), F.count("*").alias("weight")).select("id", "v", "weight", "h", "h2")


def _unit(column) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _edges(parts):
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "s"])


def _signs(seed: int, tables: int, bits: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("v"))
            for t in range(tables):
                planes = np.random.default_rng((seed, t, x.shape[1])).standard_normal((x.shape[1], bits))
                key = ((x @ planes) > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(key.astype(np.int64)), batch.column("id"), batch.column("v")], names=["t", "key", "id", "v"])

    return run


def _block_stars(ids: np.ndarray, s: np.ndarray, threshold: float):
    """Stars from each member of a block to the smallest member that pairs at the threshold connect it to."""
    near = s >= threshold
    if not near.any():
        return None
    order = np.argsort(ids)
    near = near[order][:, order]
    np.fill_diagonal(near, True)
    label = np.arange(len(ids))
    while True:
        new = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (new == label).all():
            break
        label = new[new]
    move = label != np.arange(len(ids))
    return ids[order][move], ids[order][label[move]], np.full(int(move.sum()), STAR)


def _leaf_neighbours(size: int, threshold: float):
    def run(batches):
        for batch in batches:
            parts = []
            for members in batch.column("members"):
                m = members.values
                ids, x = m.field("id").to_numpy(), _unit(m.field("v"))
                if len(ids) < 2:
                    continue
                s = x @ x.T
                np.fill_diagonal(s, -2)
                k = min(size, len(ids) - 1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(ids)), k)
                parts.append((ids[rows], ids[best.ravel()], s[rows, best.ravel()]))
                stars = _block_stars(ids, s, threshold)
                if stars:
                    parts.append(stars)
            yield _edges(parts)

    return run


def forest(vectors: DataFrame, n: int, seed: int, threshold: float, tables: int = TABLES, size: int = LIST) -> DataFrame:
    """Edges ``(a, b, s)`` to the nearest ``size`` rows of each leaf block, and its stars."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    per_dim = {r.d: r.n for r in vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    keyed = []
    for d in per_dim:
        keyed.append(vectors.where(F.size("v") == d).select("id", "v").mapInArrow(_signs(seed, tables, bits), "t int, key long, id long, v array<float>").withColumn("d", F.lit(d)))
    rows = keyed[0]
    for other in keyed[1:]:
        rows = rows.unionByName(other)
    leaf = rows.groupBy("d", "t", "key").agg(F.ceil(F.count("*") / LEAF).alias("blocks"))
    rows = rows.join(leaf, ["d", "t", "key"]).withColumn("block", F.pmod(F.xxhash64("id", "t", F.lit(seed)), "blocks"))
    met = rows.groupBy("d", "t", "key", "block").agg(F.collect_list(F.struct("id", "v")).alias("members"))
    return met.select("members").mapInArrow(_leaf_neighbours(size, threshold), _EDGES)


def _local_join(threshold: float):
    """Measure pairs of a block that have a new edge; emit those that enter a list, and the block's stars."""

    def run(batches):
        for batch in batches:
            parts = []
            for members in batch.column("members"):
                m = members.values
                ids, new, low = m.field("id").to_numpy(), m.field("new").to_numpy(zero_copy_only=False), m.field("low").to_numpy()
                ids, first = np.unique(ids, return_index=True)
                if len(ids) < 2:
                    continue
                new, low, x = new[first], low[first], _unit(m.field("v"))[first]
                s = x @ x.T
                s[~(new[:, None] | new[None, :])] = -2
                np.fill_diagonal(s, -2)
                i, j = np.nonzero(s > low[:, None])
                parts.append((ids[i], ids[j], s[i, j]))
                stars = _block_stars(ids, s, threshold)
                if stars:
                    parts.append(stars)
            yield _edges(parts)

    return run


def _merge(edges: DataFrame, graph: DataFrame | None, threshold: float) -> DataFrame:
    """The graph with new edges; ``prev`` holds what the lists had before, ``stars`` all links found by blocks."""
    best = edges.groupBy("a", "b").agg(F.max(F.when(F.col("s") < STAR, F.col("s"))).alias("s"), F.max(F.col("s") == STAR).alias("star"))
    pair, link = F.when(F.col("s").isNotNull(), F.struct("s", "b")), F.when(F.col("star"), F.col("b"))
    lists = best.groupBy("a").agg(F.sort_array(F.collect_list(pair), asc=False).alias("got"), F.collect_list(link).alias("links"))
    if graph is None:
        return lists.select("a", F.lit(LIST).alias("room"), F.slice("got", 1, LIST).alias("nbrs"), F.array().cast("array<long>").alias("prev"), F.col("links").alias("stars"))
    # a vector that was alone in its blocks so far has its first list here
    both = graph.join(lists, "a", "full").withColumn("room", F.coalesce("room", F.lit(LIST)))
    none = F.array().cast("array<struct<s:double,b:long>>")
    nbrs = F.coalesce("nbrs", none)
    full = (F.size(nbrs) >= F.col("room")) & (F.element_at(nbrs, -1)["s"] >= threshold)
    room = F.when(full, F.least(F.col("room") * 2, F.lit(MOST))).otherwise(F.col("room"))
    got = F.sort_array(F.array_distinct(F.concat(nbrs, F.coalesce("got", none))), asc=False)
    ids = F.array().cast("array<long>")
    stars = F.array_distinct(F.concat(F.coalesce("stars", ids), F.coalesce("links", ids)))
    both = both.select("a", room.alias("room"), got.alias("got"), F.transform(nbrs, lambda x: x["b"]).alias("prev"), stars.alias("stars"))
    return both.select("a", "room", F.expr("slice(got, 1, room)").alias("nbrs"), "prev", "stars")


def _round(vectors: DataFrame, graph: DataFrame, number: int, threshold: float) -> DataFrame:
    edges = graph.select("a", F.explode("nbrs").alias("e"), "prev").select("a", F.col("e.b").alias("b"), (~F.array_contains("prev", F.col("e.b"))).alias("new"))
    hubs = edges.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 2).select(F.col("b").alias("c"), F.ceil(F.col("n") * 2 / BLOCK).alias("blocks"))
    pairs = edges.selectExpr("a c", "b m", "new").unionByName(edges.selectExpr("b c", "a m", "new"))
    pairs = pairs.groupBy("c", "m").agg(F.max("new").alias("new"))
    pairs = pairs.join(hubs, "c", "left").withColumn("block", F.pmod(F.xxhash64("m", F.lit(number)), F.coalesce("blocks", F.lit(1))))
    low = F.when(F.size("nbrs") >= F.greatest("room", F.lit(1)), F.element_at("nbrs", -1)["s"]).otherwise(F.lit(-1.5))
    known = vectors.select("id", "v").join(graph.select(F.col("a").alias("id"), low.alias("low")), "id")
    met = pairs.join(known, F.col("m") == F.col("id")).groupBy("c", "block").agg(F.collect_list(F.struct("id", "v", "new", "low")).alias("members"))
    return met.where("size(members) > 1 and exists(members, x -> x.new)").select("members").mapInArrow(_local_join(threshold), _EDGES)


def descend(vectors: DataFrame, graph: DataFrame, first: int, threshold: float, rounds: int = ROUNDS) -> DataFrame:
    for number in range(first, first + rounds):
        old, graph = graph, stage(_merge(_round(vectors, graph, number, threshold), graph, threshold), "graph")
        unstage([old])
        fresh = F.size(F.array_except(F.transform("nbrs", lambda x: x["b"]), "prev"))
        seen = graph.agg(F.sum(fresh).alias("new"), F.sum(F.size("nbrs")).alias("n")).first()
        if seen.new <= CHANGED * seen.n:
            break
    return graph


def _against(sent, threshold: float):
    def run(batches):
        ids, dims, vectors = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _unit(batch.column("v")), batch.column("id").to_numpy()
            use = dims == x.shape[1]
            if use.any():
                q = np.array([v for v, u in zip(vectors, use, strict=True) if u])
                i, j = np.nonzero(x @ q.T >= threshold)
                a, b = own[i], ids[use][j]
                yield _edges([(a[a != b], b[a != b], np.zeros(int((a != b).sum())))])

    return run


def audit(vectors: DataFrame, labels: DataFrame, n: int, threshold: float, size: int = AUDIT) -> float:
    """Share of ``size`` vectors (drawn by a hash) whose true links all stay inside their component."""
    share = min(1.0, size / max(n, 1))
    drawn = vectors.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)).select("id", "v").limit(4 * size).collect()
    unit = [np.array(r.v, np.float32).astype(np.float64) for r in drawn]
    unit = [x / np.abs(x).max() for x in unit]
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r.id for r in drawn], np.int64), np.array([len(x) for x in unit]), [x / np.sqrt((x * x).sum()) for x in unit]))
    dims = [r.d for r in vectors.select(F.size("v").alias("d")).distinct().collect()]
    true = None
    for d in dims:
        part = vectors.where(F.size("v") == d).select("id", "v").mapInArrow(_against(sent, threshold), _EDGES)
        true = part if true is None else true.unionByName(part)
    la, lb = labels.selectExpr("node a", "label la"), labels.selectExpr("node b", "label lb")
    inside = true.join(la, "a", "left").join(lb, "b", "left").groupBy("b").agg(F.min(F.coalesce(F.col("la") == F.col("lb"), F.lit(False))).alias("met"))
    found = inside.agg(F.count("*").alias("n"), F.count_if("met").alias("met")).first()
    return found.met / found.n if found.n else 1.0


def _count_links(threshold: float):
    def run(batches):
        for batch in batches:
            parts = []
            for members in batch.column("members"):
                m = members.values
                ids, weight, left, right, x = m.field("id").to_numpy(), m.field("weight").to_numpy(), m.field("i").to_numpy() == 0, m.field("i").to_numpy() == 1, _unit(m.field("v"))
                if not right.any():
                    near = x @ x.T >= threshold
                    np.fill_diagonal(near, False)
                    parts.append((ids, near @ weight, np.zeros(len(ids))))
                else:
                    near = x[left] @ x[right].T >= threshold
                    parts.append((ids[left], near @ weight[right], np.zeros(int(left.sum()))))
                    parts.append((ids[right], weight[left] @ near, np.zeros(int(right.sum()))))
            yield _edges(parts)

    return run


def link_counts(vectors: DataFrame, labels: DataFrame, threshold: float, block: int = PAIR_BLOCK) -> DataFrame:
    """``(id, n)``: linked vectors of the same component, by pairs of blocks of about ``block`` rows."""
    rows = labels.join(vectors, F.col("node") == F.col("id")).select("label", "id", "v", "weight", F.size("v").alias("d"))
    size = labels.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(size, "label").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", "d", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.struct("id", "v", "weight", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("i")).alias("m"))
    met = rows.groupBy("label", "d", "p", "q").agg(F.collect_list("m").alias("members"))
    # a block that meets itself has no right side
    counts = met.select("members").mapInArrow(_count_links(threshold), _EDGES)
    return counts.groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n"))


def near_duplicates(table: DataFrame, threshold: float = 0.9, target: float = 0.995) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vec_id."""
    table = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"))
    usable = stage(usable_vectors(table), "usable")
    vectors = stage(distinct_vectors(usable), "vectors")
    n = vectors.count()
    all_ids = table.select("vec_id").distinct()
    if not n:
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    graph = None
    for attempt in range(ATTEMPTS):
        new = forest(vectors, n, attempt, threshold)
        old, graph = graph, stage(_merge(new, graph, threshold), "graph")
        if old is not None:
            unstage([old])
        graph = descend(vectors, graph, attempt * ROUNDS, threshold)
        listed = graph.select("a", F.explode("nbrs").alias("e")).where(F.col("e.s") >= threshold).selectExpr("a", "e.b b")
        edges = listed.unionByName(graph.select("a", F.explode("stars").alias("b")))
        labels = stage(components(edges), "labels")
        recall = audit(vectors, labels, n, threshold)
        if recall >= target:
            break
    else:
        raise RuntimeError(f"after {ATTEMPTS} forests only {recall:.4f} of the audited vectors have all their links in their component")
    unstage([graph])
    counts = link_counts(vectors, labels, threshold)
    each = vectors.join(labels, F.col("id") == F.col("node"), "left").join(counts, "id", "left")
    each = each.select("h", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("label", "id").alias("label"))
    each = usable.select("vec_id", "h", "h2").join(each, ["h", "h2"]).drop("h", "h2")
    out = all_ids.join(each, "vec_id", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
