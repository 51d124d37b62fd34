"""SimHash, line dedup and embedding near-dedup against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from terralag.llm import embedding_dedup, line_dedup, queries, simhash_dedup
from terralag.llm.common import components
from terralag.llm.simhash_dedup import covering_masks, near_links, shingle_hashes


def smallest(n, pairs):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components(spark, monkeypatch):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(30)]
    want = smallest(240, pairs)
    edges = spark.createDataFrame(pairs, "a long, b long")
    for limit in (10**6, 0):
        monkeypatch.setattr("terralag.llm.common.LOCAL_EDGES", limit)
        got = {r.node: r.label for r in components(edges).collect()}
        assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1] or want[x] != x or any(x in q and q[0] != q[1] for q in pairs)}


def test_covering_masks_cover():
    rng = random.Random(2)
    masks = covering_masks(3)
    assert len(masks) == 15
    for _ in range(2000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("limit", [1024, 4])
def test_near_links_against_all_pairs(spark, limit):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    fps = {int(x) for x in base}
    for x in base[:20]:
        for _ in range(12):
            y = int(x)
            for i in rng.integers(0, 63, rng.integers(1, 4)):
                y ^= 1 << int(i)
            fps.add(y)
    fps = sorted(fps)
    mask = (1 << 64) - 1
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & mask).bit_count() <= 3]
    links = near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 3, bucket_limit=limit)
    got = [(fps.index(r.a), fps.index(r.b)) for r in links.collect()]
    assert smallest(len(fps), got) == smallest(len(fps), pairs)


def brute_groups(rows):
    out = []
    for _, t in rows:
        h = shingle_hashes(t or "", 3)
        out.append(sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)))
    pairs = [(i, j) for i in range(len(out)) for j in range(i) if (out[i] ^ out[j]).bit_count() <= 3]
    return out, smallest(len(out), pairs)


def test_simhash_groups(spark, docs_of):
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, "a b c d e f"), (2, "A B\tC d  e f"), (3, None), (4, ""), (5, " \n "), (6, "one"), (7, "one two"), (8, long), (9, long + " x"), (10, "été Été É")]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash_dedup.simhash_groups(docs_of(rows)).collect()}
    prints, label = brute_groups(rows)
    assert got == {rows[i][0]: (prints[i], rows[label[i]][0]) for i in range(len(rows))}
    assert got[3][1] == got[4][1] == got[5][1] == 3
    assert simhash_dedup.simhash_groups(docs_of([])).count() == 0
    twice = simhash_dedup.simhash_groups(docs_of([(1, "x y"), (1, "x y"), (None, "x y")])).collect()
    assert [r.component_id for r in twice] == [1, 1, 1]


def test_op5_on_the_table(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    prints, label = brute_groups(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op5_simhash_near_dedup"](spark, data).collect()}
    assert got == {docs[i][0]: (f"{prints[i]:016x}", docs[label[i]][0]) for i in range(len(docs))}


def test_similar_groups_are_exact(spark, docs_of):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        near, far = list(w), list(w)
        near[5] = "edited"
        for j in range(0, 120, 12):
            far[j] = "edited"
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(far)), (300 + i, " ".join(w))]
    rows += [(400, None), (401, "")]
    docs = docs_of(rows)
    kept = simhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(12), *range(200, 212), 400])


@pytest.mark.parametrize(("block", "hot"), [(256, 20_000), (20, 20_000), (256, 7)])
def test_similar_groups_against_all_pairs(spark, docs_of, block, hot):
    """Edits of one base, alike through some of the others only, and short texts that share a fingerprint's words."""
    rng = random.Random(8)
    base, rows = [f"w{rng.randrange(4000)}" for _ in range(200)], []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(200), 4):
            w[j] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = list(base[::-1])
    for i in range(60):
        chain[(i * 7) % 200] = f"chain{i}"
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, " ".join(f"t{(i // 2 * 31 + j * j) % 50}" for j in range(8 + i % 5))) for i in range(60)]
    sets = [set(shingle_hashes(t, 5)) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {rows[i][0]: rows[k][0] for i, k in enumerate(smallest(len(rows), pairs))}
    got = {r.doc_id: r.keep_id for r in simhash_dedup.similar_groups(docs_of(rows), block=block, hot=hot).collect()}
    assert got == want


def brute_lines(rows, min_chars=20, min_docs=3):
    keys = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            keys.setdefault(line_dedup.line_key(line), set()).add(d)
    low = lambda d: (d is not None, d)
    out = []
    for d, t in rows:
        kept, lines = [], (t or "").split("\n")
        for line in lines:
            k = line_dedup.line_key(line)
            if len(k) < min_chars or len(keys[k]) < min_docs or d == max(keys[k], key=low):
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (low(r[0]), r[3]))


def line_rows():
    rng = random.Random(7)
    lines = [f"a line that many documents hold, number {i}" for i in range(8)] + ["short", "", "  Padded LINE of twenty points \t", "padded line of twenty points", "É" * 19, "É" * 20]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.7 else f"own line of document {i} {rng.random()}" for _ in range(rng.randint(0, 9)))) for i in range(200)]
    common = "one line that a third of all documents hold"
    rows += [(1000 + i, common if i % 2 else common + "\n" + common.upper()) for i in range(400)]
    return [*rows, (5000, None), (5001, ""), (None, common), (7, rows[7][1])]


@pytest.mark.parametrize("partitions", [1, 37])
def test_line_dedup_against_brute_force(spark, docs_of, partitions):
    rows = line_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = docs_of(rows)
        out = line_dedup.drop_repeated_lines(docs)
        assert out.columns == docs.columns
        got = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=lambda r: (r[0] is not None, r))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted(((d, kept) for d, _, _, kept in brute_lines(rows)), key=lambda r: (r[0] is not None, r))
    assert got == want


def test_line_dedup_empty_table(spark, docs_of):
    assert line_dedup.drop_repeated_lines(docs_of([])).count() == 0


def test_op9_on_the_table(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute_lines(docs)}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.QUERIES["op9_line_dedup"](spark, data).collect()}
    assert got == want


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_vectors(rows):
    ids, xs = [], []
    for i, v in rows:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ids.append(i)
        xs.append(np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else None)
    near = [[j for j in range(len(xs)) if j != i and xs[i] is not None and xs[j] is not None and len(xs[i]) == len(xs[j]) and xs[i] @ xs[j] >= 0.9] for i in range(len(xs))]
    label = smallest(len(xs), [(i, j) for i in range(len(xs)) for j in near[i]])
    return {ids[i]: (len(near[i]), ids[label[i]]) for i in range(len(xs))}


def test_embedding_near_duplicates(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    vecs = [base, base[:40] + 0.1 * rng.standard_normal((40, 16)), np.repeat(base[:1], 60, axis=0) + 0.05 * rng.standard_normal((60, 16)), np.repeat(base[1:2], 30, axis=0)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate(vecs))]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, [float("inf")] * 16), (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]
    got = embedding_dedup.near_duplicates(vectors_table(spark, [(i, v, 0) for i, v in rows])).collect()
    want = brute_vectors(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embedding_empty_and_repeated(spark):
    assert embedding_dedup.near_duplicates(vectors_table(spark, [])).count() == 0
    got = embedding_dedup.near_duplicates(vectors_table(spark, [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (2, [2.0, 0.0], 0)]))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {1: (1, 1), 2: (1, 1), None: (0, None)}


def test_op2_recall_on_the_table(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.QUERIES["op2_embedding_near_dedup"](spark, data).collect()}
    want = brute_vectors(rows)
    assert got == want


def test_lists_are_enlarged_and_audited(spark):
    """A group of copies larger than any list keeps all its links."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in 1 + 0.01 * rng.standard_normal(8)], 0) for i in range(150)]
    got = embedding_dedup.near_duplicates(vectors_table(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}




def test_links_between_saturated_groups_are_kept(spark):
    """Two groups of 60 near copies, 3,600 links across that no list has room for, among other vectors."""
    rng = np.random.default_rng(9)
    a = np.zeros(24)
    a[0] = 1.0
    b = np.zeros(24)
    b[:2] = 0.93, math.sqrt(1 - 0.93**2)
    tight = lambda x: x + 0.004 * rng.standard_normal((60, 24))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([tight(a), tight(b), rng.standard_normal((400, 24))]))]
    want = brute_vectors([(i, v) for i, v, _ in rows])
    assert want[0][0] == 119 and want[100][1] == 0
    got = embedding_dedup.near_duplicates(vectors_table(spark, rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_star_of_groups(spark):
    """Groups that are linked over the one in the middle only."""
    rng, rows = np.random.default_rng(10), []
    middle = np.eye(12)[0]
    for g in range(6):
        centre = middle if not g else 0.93 * middle + math.sqrt(1 - 0.93**2) * np.eye(12)[g]
        rows += [(100 * g + i, [float(x) for x in centre + 0.002 * rng.standard_normal(12)], 0) for i in range(55)]
    want = brute_vectors([(i, v) for i, v, _ in rows])
    assert {label for _, label in want.values()} == {0}
    got = embedding_dedup.near_duplicates(vectors_table(spark, rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
