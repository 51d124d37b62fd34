"""Outliers, imputation, scaling and indices on hand-made tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralag.functions import indices as ix
from terralag.functions import scalars as s
from terralag.operators import impute, outliers as out, profile as prof, scaling
from terralag.operators.relational import drop_sparse_columns
from terralag.schemas import normalise

A = [1, 2, 3, 4, 5, 6, 7, 90, 95]
B = [10, 11, 12, 13, 14, 15, 24, 40, 41]


@pytest.fixture(scope="module")
def ab(spark):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(A, B))], "id long, a double, b double")


def kept(df):
    return sorted(r["id"] for r in df.collect())


def test_sequential_iqr_depends_on_order(ab):
    assert kept(out.remove_outliers_iqr(ab, 1.5, ["a", "b"])) == [0, 1, 2, 3, 4, 5]
    assert kept(out.remove_outliers_iqr(ab, 1.5, ["b", "a"])) == [0, 1, 2, 3, 4, 5, 6]
    assert kept(out.remove_outliers_iqr(ab, 1.5, ["a", "b"], mode="joint")) == [0, 1, 2, 3, 4, 5, 6]


def test_iqr_drops_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (100.0,)], "x double")
    assert sorted(r["x"] for r in out.remove_outliers_iqr(df, 1.5).collect()) == [1.0, 2.0, 3.0]


def test_empty_and_all_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert out.remove_outliers_iqr(df).count() == 0
    assert out.mask_outliers_iqr(df).collect()[0]["y"] == 1.0


def test_robust_z(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in (1, 2, 3, 4, 100)], "x double, flat double")
    median, mad = prof.medians_and_mads(df, ["x"])["x"]
    assert mad == pytest.approx(1.4826022, abs=1e-6)
    assert (100 - median) / mad == pytest.approx(65.4255, abs=1e-3)
    masked = out.mask_outliers_robust_z(df, 3.0).toPandas()
    assert masked["x"].isna().sum() == 1 and (masked["flat"] == 5.0).all()
    assert out.remove_outliers_robust_z(df, 4.0).count() == 4


def test_winsorize(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 11), 100]], "x double")
    got = out.winsorize(df).agg(F.min("x"), F.max("x")).first()
    assert (got[0], got[1]) == (1.5, 55.0)


def test_clip_and_mask_keep_null(spark):
    df = spark.createDataFrame([(None,), (5.0,)], "x double")
    got = df.select(s.clip(F.col("x"), F.lit(6.0), F.lit(9.0)).alias("c"), s.mask_outside(F.col("x"), F.lit(6.0), F.lit(9.0)).alias("m"))
    assert [tuple(r) for r in got.collect()] == [(None, None), (6.0, None)]


def test_indices_do_not_wrap_and_divide_safely(spark):
    df = spark.createDataFrame([(100, 300), (0, 0)], "B08 smallint, B04 smallint")
    got = [r[0] for r in df.select(ix.ndvi(eps=0.0)).collect()]
    assert got == [-0.5, None]


def test_normalise(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r[0] for r in normalise(df).collect()] == [None, None, 1.0]


def test_band_share_keeps_null_rows(spark):
    df = spark.createDataFrame([(70.0,), (80.0,), (None,)], "r double")
    assert df.agg(s.in_band_percent(F.col("r"))).first()[0] == pytest.approx(100 / 3)


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.5, 5.0, 5.0, 10.0)], "x double")
    got = {r["bin"]: r["n"] for r in prof.histogram(df, "x", 4).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 1}


def test_drop_sparse_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "a int, b int")
    assert drop_sparse_columns(df).columns == ["a"]


def planted(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(10, 2, n)
    y = 3 * x + rng.normal(0, 0.1, n) + 100
    z = x - 0.5 * y + rng.normal(0, 0.1, n)
    truth = pd.DataFrame({"x": x, "y": y, "z": z})
    holes = truth.mask(rng.random(truth.shape) < [0.0, 0.2, 0.1])
    return spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in row) for row in holes.to_numpy()], "x double, y double, z double"), truth, holes


def test_iterative_fill_finds_planted_lines(spark):
    df, truth, holes = planted(spark)
    got = impute.impute_iterative(df, ["x", "y", "z"], max_iter=20).toPandas()
    got = got.sort_values("x", ignore_index=True)
    order = truth["x"].argsort()
    truth, holes = truth.iloc[order].reset_index(drop=True), holes.iloc[order].reset_index(drop=True)
    assert not got.isna().any().any()
    for c in "xyz":
        seen = holes[c].notna()
        assert (got[c][seen] == holes[c][seen]).all()
        if not seen.all():
            assert np.abs(got[c] - truth[c])[~seen].mean() < 0.5


def test_iterative_fill_forms_agree(spark):
    df, *_ = planted(spark, 300)
    a = impute.impute_iterative(df, ["x", "y", "z"], max_iter=4, tol=0.0).toPandas().sort_values("x", ignore_index=True)
    b = impute.impute_iterative(df, ["x", "y", "z"], max_iter=4, tol=0.0, pattern_limit=1).toPandas().sort_values("x", ignore_index=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-6)


def test_bayesian_ridge_equals_least_squares_on_clean_data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = 4 + x @ [2.0, -1.0] + rng.normal(0, 0.01, 500)
    z = np.column_stack([np.ones(500), x, y])
    intercept, coef = impute.bayesian_ridge(z.T @ z, 3)
    assert intercept == pytest.approx(4, abs=0.01)
    assert coef == pytest.approx([2.0, -1.0], abs=0.01)


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    for f in (scaling.standard_scale, scaling.minmax_scale, scaling.robust_scale):
        assert [r[0] for r in f(df, ["x"]).collect()] == [0.0, 0.0]


def test_probit(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.001, 0.025, 0.5, 0.975, 1.0)], "p double")
    got = [r[0] for r in df.select(scaling.probit(F.col("p"))).collect()]
    assert got == pytest.approx([-5.199337582, -3.090232306, -1.959963985, 0.0, 1.959963985, 5.199337582], abs=1e-6)


def test_quantile_transform_of_several_columns(spark):
    """Gaps stay gaps, a column without values is left alone, one with a single value becomes the lowest point."""
    rows = [(float(i), -float(i) if i % 3 else None, 7.0 if i % 2 else None, None) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for output, low, middle in (("uniform", 0.0, 0.5), ("normal", -scaling._NORMAL_CLIP, 0.0)):
        out = scaling.quantile_transform(df, ["a", "b", "c", "d"], 101, output)
        assert out.columns == df.columns
        got = {i: tuple(r) for i, r in enumerate(out.collect())}
        assert got[0] == (pytest.approx(low), None, None, None)
        assert got[50][0] == pytest.approx(middle, abs=1e-9) and got[51][1] is None
        assert got[100][:2] == (pytest.approx(-low if low else 1.0), pytest.approx(low))
        assert {r[2] for r in got.values()} == {None, low}


def test_quantile_transform_of_shared_points(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 50 + [2.0] * 50 + [None]], "x double")
    got = {r[0] for r in scaling.quantile_transform(df, ["x"], 100, "uniform").collect()}
    assert got == {0.0, 1.0, None}


def test_nearest_fill_in_blocks(spark):
    """Twelve columns driven by two numbers: blocks come close to the exact fill and far ahead of the mean."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 2)) @ rng.normal(size=(2, 12)) + 0.05 * rng.normal(size=(600, 12))
    names = [f"c{i}" for i in range(12)]
    rows = [(i, *[None if (i + j) % 29 == 0 else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "rid int, " + ", ".join(f"{c} double" for c in names))
    got = impute.impute_knn_blocks(df, "rid", names, 5, tables=6, block_rows=150).orderBy("rid").toPandas()[names].to_numpy()
    gap = np.array([[(i + j) % 29 == 0 for j in range(12)] for i in range(600)])
    assert not np.isnan(got).any() and (got[~gap] == x[~gap]).all()
    assert np.abs(got - x)[gap].mean() < 0.25 * np.abs(x - x.mean(axis=0))[gap].mean()
