"""Pipelines, penalties, searches and order choice."""

import math

import numpy as np
import pytest

from terralag.operators import forecasting as fc
from terralag.operators import tuning as tune
from terralag.operators.models import load_model, make_pipeline, save_model


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    y = 3 * x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=120) + 4
    rows = [(i, *map(float, v), float(t), i % 3) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, fold int").cache(), x, y


def centred(x, y):
    return x - x.mean(axis=0), y - y.mean()


def elastic(x, y, alpha, share):
    x, y = centred(x, y)
    w, n = np.zeros(x.shape[1]), len(y)
    for _ in range(3000):
        for j in range(x.shape[1]):
            rho = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * share, 0) / (x[:, j] @ x[:, j] / n + alpha * (1 - share))
    return w


@pytest.mark.parametrize("alpha", [1.0, 50.0])
def test_ridge_penalty(table, alpha):
    df, x, y = table
    xc, yc = centred(x, y)
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    got = make_pipeline("ridge", ["a", "b", "c"], "y", alpha=alpha).fit(df).stages[-1].coefficients.toArray()
    assert got == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize(("name", "alpha", "share"), [("lasso", 0.5, 1.0), ("elastic_net", 0.5, 0.5), ("elastic_net", 1.0, 0.2)])
def test_elastic_penalty(table, name, alpha, share):
    df, x, y = table
    extra = {} if name == "lasso" else {"l1_ratio": share}
    got = make_pipeline(name, ["a", "b", "c"], "y", alpha=alpha, **extra).fit(df).stages[-1].coefficients.toArray()
    assert got == pytest.approx(elastic(x, y, alpha, share), abs=1e-5)


@pytest.mark.parametrize("scaler", [None, "standard", "minmax", "robust", "quantile"])
def test_every_row_is_scored(table, scaler):
    df, _, _ = table
    gaps = df.selectExpr("id", "if(id % 4 = 0, null, a) a", "if(id % 4 = 1, double('NaN'), b) b", "cast(null as double) c", "y")
    fitted = make_pipeline("linear", ["a", "b", "c"], "y", scaler).fit(df)
    scored = fitted.transform(gaps).select("prediction").collect()
    assert len(scored) == 120 and all(r.prediction is not None and math.isfinite(r.prediction) for r in scored)


@pytest.mark.parametrize("select", [("variance", 0.0), ("k_best", 2), ("importance", 0.5)])
def test_selection_steps_and_saving(table, tmp_path, select):
    df, _, _ = table
    fitted = make_pipeline("linear", ["a", "b", "c"], "y", "standard", select=select).fit(df)
    assert "_f_a" in fitted.stages[2].getInputCols()
    save_model(fitted, str(tmp_path / "model"))
    again = load_model(str(tmp_path / "model"))
    assert again.transform(df).select("prediction").collect() == fitted.transform(df).select("prediction").collect()


def test_infrastructure_errors_are_raised(table, monkeypatch):
    df, _, _ = table

    def lost(*_, **__):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(tune, "make_pipeline", lost)
    with pytest.raises(RuntimeError):
        tune.search(df, tune.grid("linear"), ["a"], "y", 3)


def test_failures_keep_their_message(table):
    df, _, _ = table
    row = tune.search(df, tune.grid("random_forest", n_estimators=[0]), ["a"], "y", 3, scorer=tune.MapeEvaluator("y")).first()
    assert row.failed and row.error and row.scorer == math.inf


def test_order_choice_does_not_depend_on_the_unit(spark):
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.normal(size=80)) + 50
    rows = [(f"x{s:g}", m, float(v * s)) for s in (0.001, 1.0, 1000.0) for m, v in enumerate(walk)]
    panel = spark.createDataFrame(rows, "key string, ts int, v double")
    best = fc.search_orders(panel, "key", "ts", "v", fc.order_grid()).collect()
    assert len({tuple(r[f] for f in fc.ORDER_FIELDS) for r in best}) == 1


def test_residual_starts_are_those_of_the_fits():
    y = np.cumsum(np.random.default_rng(1).normal(size=90))
    for order in fc.order_grid():
        try:
            fit = fc.SeasonalFit(y, order)
        except ValueError:
            continue
        assert fit.offset == fc.residual_start(90, order)


def test_regressor_gaps_see_no_later_month():
    assert fc._clean_x([math.nan, math.nan, 5.0, math.nan, 7.0], True, 2).tolist() == [0.0, 0.0, 5.0, 5.0, 7.0]
    assert fc._clean_x([math.nan, 3.0, math.nan], True, 3).tolist() == [3.0, 3.0, 3.0]


def test_bagging_members_have_their_own_columns(table, tmp_path):
    df, _, y = table
    fitted = make_pipeline("bagging", ["a", "b", "c"], "y", n_estimators=4, max_features=0.67, max_depth=6).fit(df)
    slices = [tuple(s.getIndices()) for s in fitted.stages[-1].stages if hasattr(s, "getIndices")]
    assert len(slices) == 4 and len(set(slices)) > 1 and all(len(s) == 2 for s in slices)
    scored = fitted.transform(df).select("y", "prediction").toPandas()
    assert ((scored.y - scored.prediction) ** 2).mean() < y.var()
    save_model(fitted, str(tmp_path / "bag"))
    assert load_model(str(tmp_path / "bag")).transform(df).count() == 120
