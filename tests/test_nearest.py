"""Nearest-neighbour operators against brute force."""

import math
import random

import numpy as np
import pytest

from terralag.operators.impute import impute_knn
from terralag.operators.nearest import grid_snap_join, nearest_join


def brute(points, pixels):
    out = {}
    for pid, x, y in points:
        best = min(
            ((math.sqrt((px - x) ** 2 + (py - y) ** 2), qid) for qid, px, py in pixels if px is not None and py is not None),
            default=None,
        ) if x is not None and y is not None else None
        out[pid] = (best[1], best[0]) if best else (None, None)
    return out


def run(spark, points, pixels, leaf_rows=4):
    left = spark.createDataFrame(points, "pid long, x double, y double")
    right = spark.createDataFrame(pixels, "qid long, qx double, qy double")
    got = nearest_join(left, right, "pid", "qid", ("x", "y"), ("qx", "qy"), leaf_rows)
    return {r["pid"]: (r["qid"], r["distance"]) for r in got.collect()}


def check(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0]
        assert got[k][1] == pytest.approx(want[k][1], abs=1e-12)


def test_random_clustered_and_outside(spark):
    rng = random.Random(7)
    pixels = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(150)]
    # a third of all pixels in one tiny spot, and many copies of one pixel
    pixels += [(200 + i, 0.5 + rng.uniform(0, 1e-7), 0.5 + rng.uniform(0, 1e-7)) for i in range(150)]
    pixels += [(1000 - i, 0.25, 0.75) for i in range(150)]
    points = [(i, rng.uniform(-1, 2), rng.uniform(-1, 2)) for i in range(80)]
    points += [(100 + i, 0.5 + rng.uniform(-2e-7, 2e-7), 0.5) for i in range(40)]
    points += [(300, 0.25, 0.75), (301, 0.2501, 0.7499)]
    check(run(spark, points, pixels), brute(points, pixels))


def test_ties_take_the_lowest_id(spark):
    pixels = [(5, 0.0, 1.0), (2, 0.0, -1.0), (7, 1.0, 0.0), (9, 10.0, 10.0)]
    got = run(spark, [(1, 0.0, 0.0)], pixels, leaf_rows=1)
    assert got[1] == (2, 1.0)


def test_integer_grid_with_many_ties(spark):
    pixels = [(i * 12 + j, float(i), float(j)) for i in range(12) for j in range(12)]
    rng = random.Random(3)
    rng.shuffle(pixels)
    points = [(k, rng.randrange(0, 24) / 2, rng.randrange(0, 24) / 2) for k in range(60)]
    check(run(spark, points, pixels, leaf_rows=2), brute(points, pixels))


def test_missing_coordinates_and_empty_right_side(spark):
    got = run(spark, [(1, None, 0.0), (2, 0.0, 0.0)], [(1, 1.0, None), (2, 3.0, 4.0)])
    assert got == {1: (None, None), 2: (2, 5.0)}
    assert run(spark, [(1, 0.0, 0.0)], []) == {1: (None, None)}


def test_names_the_left_side_has_win(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, "left")], "id long, x double, y double, tag string")
    right = spark.createDataFrame([(8, 0.0, 1.0, "right", 3)], "qid long, x double, y double, tag string, band int")
    row = nearest_join(left, right, "id", "qid", ("x", "y"), ("x", "y")).first()
    assert (row["tag"], row["band"], row["distance"], row["y"]) == ("left", 3, 1.0, 0.0)


def test_grid_snap_equals_nearest_with_holes(spark):
    rng = random.Random(11)
    res, x0, y0 = 0.25, 10.0, 20.0
    cells = [(i, j) for i in range(12) for j in range(12) if rng.random() > 0.4]
    pixels = [(n, x0 - i * res, y0 + j * res, i, j) for n, (i, j) in enumerate(cells)]
    points = [(k, x0 - rng.uniform(-1, 4), y0 + rng.uniform(-1, 4)) for k in range(80)]
    left = spark.createDataFrame(points, "pid long, x double, y double")
    right = spark.createDataFrame(pixels, "qid long, qx double, qy double, row long, col long")
    got = grid_snap_join(left, right, "pid", "qid", ("x", "y"), ("qx", "qy"), x0, y0, res)
    check({r["pid"]: (r["qid"], r["distance"]) for r in got.collect()}, brute(points, [p[:3] for p in pixels]))


def knn_brute(rows, k):
    data = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], dtype=float)
    out, p = data.copy(), data.shape[1]
    for i, row in enumerate(data):
        for c in np.flatnonzero(np.isnan(row)):
            cand = []
            for j, other in enumerate(data):
                both = ~np.isnan(row) & ~np.isnan(other)
                if np.isnan(other[c]) or not both.any():
                    continue
                cand.append((math.sqrt(p / both.sum() * ((row - other)[both] ** 2).sum()), rows[j][0], other[c]))
            cand.sort()
            out[i, c] = np.mean([v for _, _, v in cand[:k]]) if cand else np.nanmean(data[:, c])
    return {r[0]: list(v) for r, v in zip(rows, out)}


def test_knn_small_example(spark):
    rows = [(0, 1.0, 2.0, None), (1, 3.0, 4.0, 3.0), (2, None, 6.0, 5.0), (3, 8.0, 8.0, 7.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r["id"]: r for r in impute_knn(df, "id", ["a", "b", "c"], 2).collect()}
    assert got[0]["c"] == 4.0 and got[2]["a"] == 5.5
    assert [got[1][c] for c in "abc"] == [3.0, 4.0, 3.0]


@pytest.mark.parametrize("k", [1, 5])
def test_knn_equals_brute_force(spark, k):
    rng = random.Random(5)
    rows = []
    for i in range(220):
        values = [rng.gauss(0, 1), rng.gauss(5, 3), rng.uniform(0, 100), rng.gauss(0, 1e-3)]
        rows.append((i, *[None if rng.random() < 0.15 else v for v in values]))
    rows += [(1000 + i, 0.5, 4.0, 50.0, 0.0) for i in range(60)]  # one hot group of copies
    rows += [(2000, None, None, None, None), (2001, 0.5, 4.0, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = {r["id"]: [r[c] for c in "abcd"] for r in impute_knn(df, "id", list("abcd"), k).collect()}
    want = knn_brute(rows, k)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-12)
