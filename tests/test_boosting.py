"""Boosted trees of one task against Spark's, and the candidates of L7 at their own size."""

import numpy as np
import pytest

from terralag.operators import boosting
from terralag.operators.models import load_model, make_pipeline, save_model
from terralag.plans import modelling


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(3).normal(size=(150, 3)).round(2)
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + 0.1 * x[:, 0]
    return spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, y double").cache()


def scored(fitted, df):
    return np.array([r.prediction for r in fitted.transform(df).select("prediction").collect()])


@pytest.mark.parametrize("extra", [{}, {"min_child_weight": 5}, {"gamma": 0.01}])
def test_same_trees_as_spark(table, extra):
    params = {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.2, **extra}
    want, got = (make_pipeline("xgboost", ["a", "b", "c"], "y", "robust", packed=p, **params).fit(table) for p in (False, True))
    assert isinstance(got.stages[-1], boosting.BoostedTrees)
    assert scored(got, table) == pytest.approx(scored(want, table), abs=1e-9)


def test_draws_repeat_and_models_are_saved(table, tmp_path, monkeypatch):
    params = {"n_estimators": 30, "max_depth": 5, "subsample": 0.7, "colsample_bytree": 0.8}
    fit = lambda df: make_pipeline("xgboost", ["a", "b", "c"], "y", packed=True, **params).fit(df)
    first = fit(table)
    save_model(first, str(tmp_path / "boosted"))
    assert np.array_equal(scored(load_model(str(tmp_path / "boosted")), table), scored(first, table))
    assert np.array_equal(scored(fit(table.repartition(5)), table), scored(first, table))
    y = np.array([r.y for r in table.collect()])
    assert ((scored(first, table) - y) ** 2).mean() < 0.05 * y.var()
    monkeypatch.setattr(boosting, "PACKED_ROWS", 10)
    assert fit(table).stages[-1].getNumTrees == 30


def test_candidates_keep_their_trees():
    assert [c["params"]["n_estimators"] for c in modelling.candidates()] == [300, 600, 600, 300, 300, 600, 400, 300, 300, 200]


def test_unlimited_trees_of_many_rows(spark, monkeypatch):
    """Above DEEP_ROWS a tree is arrays from one task; its leaves are those of Spark's tree."""
    x = np.random.default_rng(4).integers(0, 400, size=(600, 3))
    rows = [(*map(float, v), float(v[0] * 3 + v[1] % 7 + i / 600)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").cache()
    fit = lambda name, **p: make_pipeline(name, ["a", "b", "c"], "y", **p).fit(df)
    want = fit("decision_tree")
    monkeypatch.setattr(boosting, "DEEP_ROWS", 100)
    monkeypatch.setattr(boosting, "CELLS", 300)
    got, bag = fit("decision_tree"), fit("bagging", n_estimators=3, max_samples=0.8)
    assert isinstance(got.stages[-1], boosting.BoostedTrees) and not isinstance(want.stages[-1], boosting.BoostedTrees)
    assert sum(isinstance(s, boosting.BoostedTrees) for s in bag.stages[-1].stages) == 3
    assert scored(got, df) == pytest.approx(scored(want, df), abs=1e-9)
    y = np.array([r.y for r in df.collect()])
    assert ((scored(bag, df) - y) ** 2).mean() < 0.02 * y.var()
    assert not isinstance(fit("decision_tree", max_depth=5).stages[-1], boosting.BoostedTrees)
