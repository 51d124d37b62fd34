"""Linear models from moments against refits and brute force; saved steps; the stage cache."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralag.operators import moments as mo
from terralag.operators.folds import k_folds
from terralag.operators.models import load_model, make_pipeline, save_model
from terralag.operators.selection import forward_selection
from terralag.sources import files

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    a, b = rng.normal(1e4, 3.0, 400), rng.normal(-5, 2.0, 400)
    c = 0.5 * b + rng.normal(0, 1.0, 400)
    y = 3 + 0.2 * (a - 1e4) - 0.7 * b + 0.1 * c + rng.normal(0, 0.3, 400) + 20
    return np.column_stack([a, b, c, y])


@pytest.fixture(scope="module")
def table(spark, sample):
    rows = [(i, *map(float, r)) for i, r in enumerate(sample)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0, 1.0), (901, math.inf, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, y double")
    return df.cache()


def least_squares(x, y):
    coef, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)
    return coef[0], coef[1:]


def test_moments_and_prefixes_equal_refits(table, sample):
    m = mo.grouped_moments(table, [*NAMES, "y"])[None]
    assert m.n == 400 and m.mean == pytest.approx(sample.mean(axis=0)) and m.cross == pytest.approx(np.cov(sample.T, bias=True) * 400)
    for n, coef in enumerate(mo.prefix_coefficients(m), 1):
        want0, want = least_squares(sample[:, :n], sample[:, 3])
        assert coef == pytest.approx(want, rel=1e-8)
        part = mo.pick(m, range(n))
        left = sample[:, 3] - want0 - sample[:, :n] @ want
        assert mo.squared_error(part, float(part.mean[-1] - coef @ part.mean[:-1]), coef) == pytest.approx(left @ left, rel=1e-8)


def test_dependent_and_constant_columns_get_no_weight(sample):
    x = np.column_stack([sample[:, 0], 2 * sample[:, 0] + 1, np.full(400, 7.0), sample[:, 1], sample[:, 3]])
    m = mo.Moments(400.0, x.mean(axis=0), np.cov(x.T, bias=True) * 400)
    coef = mo.prefix_coefficients(m)[-1]
    assert coef[1] == coef[2] == 0 and coef[[0, 3]] == pytest.approx(least_squares(sample[:, :2], sample[:, 3])[1], rel=1e-6)


def test_forward_selection_equals_refits_of_the_pipeline(table):
    data = k_folds(table.filter("id < 900"), "id", 4)
    got = mo.linear_forward_selection(data, NAMES, "y").collect()
    want = forward_selection(data, NAMES, "y", folds=4, model="linear", scaler=None, solver="normal").collect()
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:2] == tuple(w)[:2] and tuple(g)[2:] == pytest.approx(tuple(w)[2:], rel=1e-7, abs=1e-8)


def test_jobs_do_not_grow_with_the_models(spark, table):
    data = k_folds(table, "id", 4)

    def jobs(subsets, penalties):
        spark.sparkContext.setJobGroup(f"g{len(subsets)}", "count")
        mo.fold_report(data, subsets, "y", penalties)
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(f"g{len(subsets)}")
        spark.sparkContext.setJobGroup("", "")
        return len(found)

    assert jobs([["a"]], (0.0,)) == jobs([["a"], ["a", "b"], ["c"], ["b", "c", "a"]], (0.0, 1.0, 10.0, 100.0))


def test_ridge_scores_equal_refits(table, sample):
    data = k_folds(table.filter("id < 900"), "id", 3)
    rows = mo.linear_scores(data, [["b", "c"], ["c"]], "y", (0.0, 50.0)).collect()
    fold = {r.id: r.fold for r in data.collect()}
    assert len(rows) == 12
    for r in rows:
        places = [NAMES.index(f) for f in r.features]
        train = np.array([s for i, s in enumerate(sample) if fold[i] != r.fold])
        test = np.array([s for i, s in enumerate(sample) if fold[i] == r.fold])
        x, y = train[:, places] - train[:, places].mean(axis=0), train[:, 3] - train[:, 3].mean()
        coef = np.linalg.solve(x.T @ x + r.alpha * np.eye(len(places)), x.T @ y)
        left = test[:, 3] - train[:, 3].mean() - (test[:, places] - train[:, places].mean(axis=0)) @ coef
        assert r.coefficients == pytest.approx(coef, rel=1e-8) and r.rmse == pytest.approx(math.sqrt((left**2).mean()), rel=1e-8)
        assert r.mape_fraction == pytest.approx(np.abs(left / test[:, 3]).mean(), rel=1e-8)


def objective(m, b, penalty):
    spread = np.sqrt(np.diag(m.cross)[:-1] / m.n)
    return mo.squared_error(m, float(m.mean[-1] - b @ m.mean[:-1]), b) / m.n / 2 + penalty * np.abs(b * spread).sum()


def test_lasso_path_is_optimal_everywhere():
    rng = np.random.default_rng(2)
    for trial in range(6):
        p = 6
        x = rng.normal(size=(60, p)) @ rng.normal(size=(p, p)) + 5
        y = x @ np.where(rng.uniform(size=p) < 0.5, rng.normal(size=p), 0) + rng.normal(size=60)
        z = np.column_stack([x, y])
        m = mo.Moments(60.0, z.mean(axis=0), np.cov(z.T, bias=True) * 60)
        knots = mo.lasso_path(m)
        assert [k for k, _ in knots] == sorted((k for k, _ in knots), reverse=True) and not knots[0][1].any()
        assert knots[-1][1] == pytest.approx(least_squares(x, y)[1], rel=1e-6)
        spread = x.std(axis=0)
        for share in (0.9, 0.5, 0.2, 0.03):
            level = knots[0][0] * share
            b = mo.lasso_at(knots, level)
            left = y - y.mean() - (x - x.mean(axis=0)) @ b
            slope = (x - x.mean(axis=0)).T @ left / 60 / spread
            for j in range(p):
                assert abs(slope[j]) <= level * (1 + 1e-7)
                assert not b[j] or slope[j] == pytest.approx(math.copysign(level, b[j]), rel=1e-6)


def test_criteria_drop_columns_without_a_share(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5))
    y = 2 * x[:, 1] + rng.normal(size=500)
    rows = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*"abcde", "y"])
    m = mo.grouped_moments(rows, [*"abcde", "y"])[None]
    fit = mo.choose_lasso(m, "bic")
    assert [c for c, w in zip("abcde", fit.coefficients) if w] == ["b"]
    assert (mo.choose_lasso(m, "aic").coefficients != 0).sum() >= 1


@pytest.fixture(scope="module")
def spoilt(spark):
    """A line, and 30 % of rows far off to one side."""
    rng = np.random.default_rng(6)
    x = rng.uniform(-5, 5, (600, 2))
    y = 4 + 1.5 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 0.1, 600)
    y[:180] += rng.uniform(20, 60, 180)
    return x, y, spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, y double")


def test_consensus_finds_the_line(spoilt):
    x, y, rows = spoilt
    fit = mo.consensus(rows, ["a", "b"], "y", "id", width=0.5)
    assert fit.intercept == pytest.approx(4, abs=0.03) and fit.coefficients == pytest.approx([1.5, -2], abs=0.02) and fit.note["near"] >= 415
    assert mo.consensus(rows, ["a", "b"], "y", "id").coefficients == pytest.approx([1.5, -2], abs=0.5)


def test_median_regression(spoilt, table):
    x, y, rows = spoilt
    fit = mo.quantile_regression(rows, ["a", "b"], "y")
    loss = lambda c0, c: np.abs(y - c0 - x @ c).sum()
    assert fit.coefficients == pytest.approx([1.5, -2], abs=0.02)
    best = loss(fit.intercept, fit.coefficients)
    rng = np.random.default_rng(0)
    assert all(best <= loss(fit.intercept + rng.normal(0, 0.02), fit.coefficients + rng.normal(0, 0.02, 2)) * (1 + 1e-4) for _ in range(200))
    assert mo.quantile_regression(rows, [], "y", 0.5).intercept == pytest.approx(float(np.median(y)))
    assert mo.quantile_regression(rows, [], "y", 0.9).intercept == pytest.approx(float(np.quantile(y, 0.9)))


def test_huber_solves_its_equations(spoilt):
    x, y, rows = spoilt
    rows = rows.filter("id >= 120")
    fit = mo.huber(rows, ["a", "b"], "y")
    x, y = x[120:], y[120:]
    z = (y - fit.intercept - x @ fit.coefficients) / fit.note["scale"]
    pull = np.clip(z, -1.35, 1.35)
    assert np.abs(np.column_stack([np.ones(len(x)), x]).T @ pull / len(x)).max() < 1e-4
    assert (np.minimum(np.abs(z), 1.35) ** 2).sum() == pytest.approx(len(x), rel=1e-3)
    assert np.abs(fit.coefficients - [1.5, -2]).max() < np.abs(least_squares(x, y)[1] - [1.5, -2]).max() + 1e-9


def test_kernel_regression_is_near_the_exact_kernel(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-2, 2, (500, 2))
    y = np.sin(2 * x[:, 0]) * x[:, 1] + rng.normal(0, 0.05, 500)
    rows = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ["a", "b", "y"])
    fit = mo.kernel_regression(rows, ["a", "b"], "y", alpha=0.1)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    kernel = np.exp(-0.5 * ((z[:, None] - z[None]) ** 2).sum(axis=2))
    exact = y.mean() + kernel @ np.linalg.solve(kernel + 0.1 * np.eye(500), y - y.mean())
    error = np.sqrt(((fit.predict(x) - exact) ** 2).mean()) / exact.std()
    assert error < 0.05, error


def test_collinearity(spark, table, sample):
    got = {r.column: r for r in mo.collinearity(table.withColumns({"twice": F.col("a") * 2, "flat": F.lit(1.0)}), [*NAMES, "twice", "flat"], 0.5).collect()}
    assert got["a"].vif is None and got["flat"].vif is None and got["flat"].group is None
    assert got["a"].group == got["twice"].group == 1 and got["b"].group == got["c"].group == 2
    r2 = np.corrcoef(sample[:, 1], least_squares(sample[:, [0, 2]], sample[:, 1])[0] + sample[:, [0, 2]] @ least_squares(sample[:, [0, 2]], sample[:, 1])[1])[0, 1] ** 2
    assert got["b"].vif == pytest.approx(1 / (1 - r2), rel=1e-6) and got["b"].r2 == pytest.approx(r2, rel=1e-6)


STEPS = [
    ("linear", "quantile", None, {}), ("linear", "standard", ("variance", 0.001), {}), ("linear", "minmax", ("k_best", 2), {}), ("ridge", "robust", ("importance", 0.5), {}),
    ("bagging", None, None, {"n_estimators": 2, "max_depth": 3}), ("huber", None, None, {}), ("quantile", "standard", None, {"rounds": 4}), ("ransac", None, None, {"trials": 20}),
    ("lasso_lars_ic", "quantile", None, {}), ("kernel_ridge", "standard", None, {"waves": 32}),
]


@pytest.mark.parametrize(("model", "scaler", "select", "params"), STEPS)
def test_saved_pipelines_predict_the_same(spark, table, tmp_path, model, scaler, select, params):
    fitted = make_pipeline(model, NAMES, "y", scaler, select=select, **params).fit(table)
    save_model(fitted, str(tmp_path / "m"))
    loaded = load_model(str(tmp_path / "m"))
    want = {r.id: r.prediction for r in fitted.transform(table).select("id", "prediction").collect()}
    got = {r.id: r.prediction for r in loaded.transform(table).select("id", "prediction").collect()}
    assert got == want and len(got) == 402 and all(v is not None for v in got.values())


def test_stage_cache(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    rows = lambda: spark.read.parquet(source).withColumn("x", F.col("id") * 2)
    assert files.write_once(rows(), path) and spark.read.parquet(path).count() == 5
    assert not files.write_once(rows(), path)
    assert files.write_once(rows(), path, version="2") and not files.write_once(rows(), path, version="2")
    spark.range(3).write.mode("append").parquet(source)
    assert files.write_once(rows(), path, version="2") and spark.read.parquet(path).count() == 8
    os.remove(path + ".committed")  # as after a job that was lost while it wrote
    for name in os.listdir(path)[:1]:
        os.remove(os.path.join(path, name))
    assert files.write_once(rows(), path, version="2") and spark.read.parquet(path).count() == 8
    assert not [n for n in os.listdir(tmp_path) if n.startswith("out.") and n != "out.committed" and not n.startswith(".")]
