"""Products of polynomials, one-pass forecasts, stored models, residual diagnostics and keyed boosting."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest

from terralag.functions.special import chi_square_tail
from terralag.operators import diagnostics as diag
from terralag.operators import forecast_state as state
from terralag.operators import forecasting as fc
from terralag.operators import seasonal


def planted(n, phi, sphi, theta, stheta, seed=1):
    rng = np.random.default_rng(seed)
    e = rng.standard_normal(n + 300)
    ar = np.convolve(seasonal.lag_polynomial([phi], 1, -1.0), seasonal.lag_polynomial([sphi], 12, -1.0))
    ma = np.convolve(seasonal.lag_polynomial([theta], 1, 1.0), seasonal.lag_polynomial([stheta], 12, 1.0))
    raw = np.convolve(e, ma)[: n + 300]
    return np.convolve(raw, seasonal.inverse_series(ar, n + 300))[: n + 300][300:]


def month_ends(n):
    firsts = [dt.date(2001 + m // 12, m % 12 + 1, 1) for m in range(1, n + 1)]
    return [d - dt.timedelta(days=1) for d in firsts]


def panel_of(spark, series):
    rows = [(k, t, float(v), float(i % 7)) for k, y in series.items() for i, (t, v) in enumerate(zip(month_ends(len(y)), y))]
    return spark.createDataFrame(rows, "k string, t date, y double, x double")


def orders_of(spark, keys, order):
    return spark.createDataFrame([(k, *order) for k in keys], f"k string, {fc.ORDER_SCHEMA}")


def test_planted_products_are_recovered():
    fit = fc.SeasonalFit(planted(4000, 0.6, 0.5, 0.4, -0.3), (1, 0, 1, 1, 0, 1))
    assert fit.coef == pytest.approx([0.6, 0.5, 0.4, -0.3], abs=0.06)
    assert fit.offset == fc.residual_start(4000, (1, 0, 1, 1, 0, 1))


def test_product_fit_is_a_minimum():
    y = planted(150, 0.5, 0.4, 0.3, 0.2, seed=2)
    fit = fc.SeasonalFit(y, (1, 0, 1, 1, 0, 1))
    model = seasonal.ProductModel(fit.w, None, 1, 1, 1, 1, 12)
    for i in range(4):
        for step in (-1e-3, 1e-3):
            near = fit.coef.copy()
            near[i] += step
            assert model.at(near).sse >= float(fit.resid @ fit.resid) - 1e-9


def test_slopes_are_derivatives():
    rng = np.random.default_rng(4)
    model = seasonal.ProductModel(rng.standard_normal(80), rng.standard_normal(80), 2, 1, 1, 2, 12)
    at = np.array([0.3, -0.2, 0.4, 0.2, 0.3, -0.1, 0.7])
    fit, slopes = model.at(at, slopes=True)
    for i in range(len(at)):
        up, down = at.copy(), at.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        rise = (model.at(up).e - model.at(down).e)[model.start :] / 2e-6
        assert slopes[:, i] == pytest.approx(rise, abs=1e-5)


def test_inverse_series_and_invertibility():
    poly = np.array([1.0, 0.5, -0.2, 0.0, 0.1])
    assert np.convolve(poly, seasonal.inverse_series(poly, 40))[:40] == pytest.approx(np.eye(40)[0], abs=1e-12)
    assert seasonal.invertible([]) and seasonal.invertible([0.9]) and seasonal.invertible([0.0, 0.0, 0.5])
    assert not seasonal.invertible([1.0]) and not seasonal.invertible([0.2, 1.1]) and not seasonal.invertible([math.nan]) and not seasonal.invertible([0, 0, 1.5])
    for c in ([0.5, 0.3], [-1.2, 0.5], [1.4, 0.5], [0.1, -0.95]):
        assert seasonal.invertible(c) == (np.abs(np.roots([*c[::-1], 1.0])).min() > 1)


def test_forecast_of_a_product_is_the_next_fitted_value():
    y = planted(200, 0.5, 0.4, 0.3, 0.2, seed=5)
    fit = fc.SeasonalFit(y[:-1], (1, 0, 1, 1, 0, 1))
    again = seasonal.ProductModel(y, None, 1, 1, 1, 1, 12).at(fit.coef)
    assert fit.forecast() == pytest.approx(y[-1] - again.e[-1])


@pytest.mark.parametrize("order", [(1, 0, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0), (0, 1, 0, 2, 0, 0), (2, 2, 0, 0, 1, 0), (0, 0, 0, 0, 0, 0)])
@pytest.mark.parametrize("with_x", [False, True])
def test_one_pass_equals_refits(order, with_x):
    rng = np.random.default_rng(3)
    y, x = np.cumsum(rng.standard_normal(90)) * 10 + 1000, rng.standard_normal(90) if with_x else None
    assert fc.linear_in_coefficients(order)
    for origin, guess in zip(range(5, 90), fc.recursive_guesses(y, order, range(5, 90), x)):
        try:
            want = fc.SeasonalFit(y[:origin], order, None if x is None else x[:origin]).forecast(None if x is None else x[origin])
        except ValueError:
            assert guess is None
            continue
        assert guess == pytest.approx(want, rel=1e-8)


def test_rolling_forecasts_take_either_path(spark):
    y = {"a": planted(80, 0.5, 0, 0, 0), "b": planted(60, 0.3, 0.2, 0, 0, seed=8), "short": [1.0, 2.0]}
    best = orders_of(spark, ["a", "short"], (1, 0, 0, 0, 0, 0)).unionByName(orders_of(spark, ["b"], (1, 0, 0, 1, 0, 0)))
    for exog in (None, "x"):
        got = fc.rolling_forecasts(panel_of(spark, y), best, "k", "t", "y", 6, exog).collect()
        assert len(got) == 13
        for r in got:
            order = (1, 0, 0, 1 if r.k == "b" else 0, 0, 0)
            xs = [float(i % 7) for i in range(len(y[r.k]))]
            try:
                want = fc.SeasonalFit(y[r.k][: r.pos], order, xs[: r.pos] if exog else None).forecast(xs[r.pos] if exog else None)
            except ValueError:
                want = y[r.k][r.pos - 1]
            assert r.predicted == pytest.approx(want, rel=1e-8)


def test_singular_designs_are_refitted(spark):
    got = fc.rolling_forecasts(panel_of(spark, {"flat": [5.0] * 40}), orders_of(spark, ["flat"], (2, 0, 0, 0, 0, 0)), "k", "t", "y", 3).collect()
    assert [r.predicted for r in got] == pytest.approx([5.0] * 3)


@pytest.mark.parametrize("order", [(1, 0, 0, 0, 0, 0), (1, 1, 1, 0, 0, 0), (1, 0, 1, 1, 0, 1), (0, 1, 0, 0, 1, 0)])
@pytest.mark.parametrize("exog", [None, "x"])
def test_stored_models_forecast_like_fitted_ones(spark, tmp_path, order, exog):
    y = {"a": planted(90, 0.5, 0.3, 0.2, 0.1), "b": planted(70, 0.2, 0.1, 0.3, 0.2, seed=9) + 50, "short": [1.0, 2.0]}
    models = state.fit_models(panel_of(spark, y), orders_of(spark, y, order), "k", "t", "y", exog)
    state.save_models(models, str(tmp_path / "m"))
    loaded = state.load_models(spark.newSession(), str(tmp_path / "m"), "k")
    future = [(k, t, float(i)) for k in ("a", "b") for i, t in enumerate(month_ends(120)) if i >= len(y[k])]
    future = spark.createDataFrame(future, "k string, t date, x double") if exog else None
    got = {(r.k, r.step): (r.t, r.predicted) for r in state.forecast_models(loaded, "k", "t", 3, future, exog).collect()}
    assert {k for k, _ in got} == {"a", "b"}
    for k in ("a", "b"):
        n, xs = len(y[k]), [float(i % 7) for i in range(len(y[k]))] if exog else None
        fit = fc.SeasonalFit(y[k], order, xs)
        t, first = got[k, 1]
        assert first == pytest.approx(fit.forecast(float(n) if exog else None)) and t == month_ends(n + 1)[-1]


def test_diagnostics(spark):
    rng = np.random.default_rng(0)
    e = {"noise": rng.standard_normal(200), "walk": np.cumsum(rng.standard_normal(200)), "flat": np.full(20, 2.0), "one": np.ones(1)}
    rows = [(k, t, float(v)) for k, x in e.items() for t, v in zip(month_ends(len(x)), x)] + [("noise", dt.date(1990, 1, 31), None)]
    residuals = spark.createDataFrame(rows, "k string, t date, residual double")
    got = {(r.k, r.lag): r for r in diag.autocorrelations(residuals, "k", "t", 8, used=1).collect()}
    z = e["walk"] - e["walk"].mean()
    rs = [z[i:] @ z[:-i] / (z @ z) for i in range(1, 9)]
    q = [200 * 202 * sum(r * r / (200 - i) for i, r in enumerate(rs[:k], 1)) for k in range(1, 9)]
    assert [got["walk", i].r for i in range(1, 9)] == pytest.approx(rs) and [got["walk", i].q for i in range(1, 9)] == pytest.approx(q)
    assert got["walk", 1].p_value is None and got["walk", 8].p_value < 1e-6 < 0.001 < got["noise", 8].p_value
    assert got["flat", 3].r is None and got["flat", 3].p_value is None and ("one", 1) not in got
    shape = {r.k: r for r in diag.normality(residuals, "k", "t").collect()}
    x = e["noise"] - e["noise"].mean()
    skew, kurt = (x**3).mean() / (x**2).mean() ** 1.5, (x**4).mean() / (x**2).mean() ** 2
    assert shape["noise"].jarque_bera == pytest.approx(200 / 6 * (skew**2 + (kurt - 3) ** 2 / 4)) and shape["noise"].n == 200
    assert shape["noise"].spread_ratio == pytest.approx((e["noise"][-66:] ** 2).sum() / (e["noise"][:66] ** 2).sum())
    assert shape["flat"].jarque_bera is None
    points = sorted((r for r in diag.normal_scores(residuals, "k", "t").collect() if r.k == "noise"), key=lambda r: r.place)
    assert [r.score for r in points] == pytest.approx([statistics.NormalDist().inv_cdf((i - 0.375) / 200.25) for i in range(1, 201)], rel=1e-6, abs=1e-9)
    assert [r.standardised for r in points] == pytest.approx(sorted(x / x.std()))


def test_chi_square_tails():
    for x, n, p in ((3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.5, 3, 0.9188914116546758), (100.0, 4, 51 * math.exp(-50)), (0.0, 2, 1.0)):
        assert chi_square_tail(x, n) == pytest.approx(p, rel=1e-10)


def test_boosted_stumps_learn_a_step():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (200, 3))
    y = np.where(x[:, 1] > 0.2, 3.0, -1.0)
    start, trees = fc.boost_stumps(x, y)
    guess = start + sum(np.where(x[:, j] <= cut, a, b) for j, cut, a, b in trees)
    assert np.abs(guess - y).max() < 0.01
    assert fc.boost_stumps(np.ones((5, 2)), np.arange(5.0)) == (2.0, [])


def test_hybrid_models_are_per_series(spark):
    y = {"a": planted(80, 0.5, 0, 0, 0), "b": planted(80, 0.3, 0, 0, 0, seed=3), "tiny": planted(8, 0.1, 0, 0, 0)}

    def forecasts(series):
        panel, best = panel_of(spark, series), orders_of(spark, series, (0, 1, 0, 0, 0, 0))
        rolling = fc.rolling_forecasts(panel, best, "k", "t", "y", 6)
        return {(r.k, r.t): r for r in fc.hybrid_forecasts(rolling, fc.residual_table(panel, best, "k", "t", "y"), "k", "t").collect()}

    got, other = forecasts(y), forecasts(y | {"b": planted(80, -0.6, 0, 0.4, 0, seed=4) * 9})
    assert all(got[k].hybrid == other[k].hybrid for k in got if k[0] == "a")
    assert any(got[k].hybrid != got[k].predicted for k in got if k[0] == "a")
    assert all(r.hybrid == r.predicted and r.residual_forecast is None for k, r in got.items() if k[0] == "tiny")
    assert {k[0] for k in got} == {"a", "b", "tiny"}
