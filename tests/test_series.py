"""Calendar operators, unit roots and forecasts."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralag.operators import forecasting as fc
from terralag.operators import series as ser
from terralag.operators.stationarity import adf, adf_p_value, unit_root_tests


def months(n, start="2000-01-31"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="ME")]


def panel_of(spark, **series):
    rows = [(k, d, float(v)) for k, values in series.items() for d, v in zip(months(len(values)), values)]
    return spark.createDataFrame(rows, "key string, ts date, value double")


def test_fill_and_change(spark):
    df = spark.createDataFrame([(0, 2.0), (1, None), (2, 3.0), (3, 6.0)], "id long, v double")
    filled = ser.fill_missing(df, ["v"], "id")
    assert [r["v"] for r in filled.orderBy("id").collect()] == [2.0, 2.0, 3.0, 6.0]
    changes = ser.percent_change(filled, "v", "id").orderBy("id").collect()
    assert [r["change"] for r in changes] == [None, 0.0, 0.5, 1.0]


def test_missing_months_come_back_as_null(spark):
    rows = [(dt.date(2020, 1, 3), 10.0), (dt.date(2020, 2, 9), 12.0), (dt.date(2020, 4, 1), 9.0)]
    df = spark.createDataFrame(rows, "data date, v double")
    got = ser.month_end_series(df.withColumn("k", F.lit(1)), "data", ["v"], ["k"]).orderBy("month_end").collect()
    assert [(r["month_end"], r["v"]) for r in got] == [
        (dt.date(2020, 1, 31), 10.0),
        (dt.date(2020, 2, 29), 12.0),
        (dt.date(2020, 3, 31), None),
        (dt.date(2020, 4, 30), 9.0),
    ]


def test_next_month(spark):
    df = spark.createDataFrame([(dt.date(2004, 6, 30),)], "m date")
    assert ser.move_to_next_month(df, "m").first()["data"] == dt.date(2004, 7, 1)


def test_single_row_month_has_no_std(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0)], "k string, d date, v double")
    assert ser.monthly_std(df, "d", "v", ["k"]).first()["v"] is None


def test_decomposition(spark):
    values = [t + {1: 1.0, 3: -1.0}.get(t % 12, 0.0) for t in range(24)]
    got = ser.decompose(panel_of(spark, a=values), "ts", "value", ["key"]).orderBy("position").toPandas()
    assert got["trend"].notna().sum() == 12
    assert got["trend"].dropna().to_numpy() == pytest.approx(np.arange(6.0, 18.0))
    assert got["seasonal"][:12].to_numpy() == pytest.approx([0, 1, 0, -1] + [0] * 8, abs=1e-12)


def test_expanding_folds(spark):
    got = ser.expanding_folds(panel_of(spark, a=range(14)), "key", "ts", 5)
    val = got.filter("part = 'val'").groupBy("fold").agg(F.min("value"), F.max("value")).orderBy("fold").collect()
    assert [(r[1], r[2]) for r in val] == [(4, 5), (6, 7), (8, 9), (10, 11), (12, 13)]
    train = got.filter("part = 'train'").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in train] == [4, 6, 8, 10, 12]


def test_align_then_carry(spark):
    panel = panel_of(spark, a=range(4))
    other = spark.createDataFrame([(months(4)[0], 1.0), (months(4)[2], 3.0)], "ts date, x double")
    got = ser.align_to(panel, other, "key", "ts", "x").orderBy("ts").collect()
    assert [r["x"] for r in got] == [1.0, 1.0, 3.0, 3.0]


def test_adf(spark):
    rng = np.random.default_rng(4)
    noise, walk = rng.normal(size=200), np.cumsum(rng.normal(size=200))
    assert adf(noise)[1] < 0.01
    assert adf(walk)[1] > 0.05
    assert adf(np.ones(50)) is None
    # published critical values of the constant-only test
    assert adf_p_value(-2.86) == pytest.approx(0.05, abs=0.002)
    assert adf_p_value(-3.43) == pytest.approx(0.01, abs=0.001)
    got = unit_root_tests(panel_of(spark, noise=noise, walk=walk, flat=[1.0] * 30), "key", "ts", "value").toPandas()
    forms = got.groupby("key")["form"].apply(set)
    assert forms["walk"] == {"level", "difference"} and forms["noise"] == {"level"}
    assert got[got["key"] == "flat"]["p_value"].isna().all()


def test_autoregression_is_recovered():
    rng = np.random.default_rng(2)
    y = np.zeros(600)
    for t in range(1, 600):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    fit = fc.SeasonalFit(y, (1, 0, 0, 0, 0, 0))
    assert fit.coef[0] == pytest.approx(0.7, abs=0.08)
    assert fit.aic < fc.SeasonalFit(y, (0, 0, 0, 0, 0, 0)).aic


def test_moving_average_is_recovered():
    rng = np.random.default_rng(8)
    e = rng.normal(size=2000)
    y = e.copy()
    y[1:] += 0.5 * e[:-1]
    assert fc.SeasonalFit(y, (0, 0, 1, 0, 0, 0)).coef[0] == pytest.approx(0.5, abs=0.1)


def test_differencing_is_undone():
    t = np.arange(60.0)
    season = np.tile(np.arange(12.0), 5)
    assert fc.SeasonalFit(2 * t, (0, 1, 0, 0, 0, 0)).forecast() == pytest.approx(118.0)  # random walk: last value
    assert fc.SeasonalFit(2 * t, (0, 2, 0, 0, 0, 0)).forecast() == pytest.approx(120.0)
    assert fc.SeasonalFit(season, (0, 0, 0, 0, 1, 0)).forecast() == pytest.approx(0.0)
    assert fc.SeasonalFit(season + 3 * t, (0, 1, 0, 0, 1, 0)).forecast() == pytest.approx(180.0)


def test_regressor_is_used():
    rng = np.random.default_rng(6)
    x = rng.normal(size=100)
    fit = fc.SeasonalFit(2.0 * x, (0, 0, 0, 0, 0, 0), x)
    assert fit.forecast(5.0) == pytest.approx(10.0)
    with pytest.raises(ValueError):
        fc.SeasonalFit([1.0, 2.0, 3.0], (2, 2, 2, 2, 2, 2))


def random_walks(spark, n=48):
    rng = np.random.default_rng(9)
    return panel_of(spark, a=10 + np.cumsum(rng.normal(size=n)), b=20 + np.cumsum(rng.normal(size=n)))


def best_for(spark, keys, order):
    return spark.createDataFrame([(k, *order) for k in keys], "key string, " + fc.ORDER_SCHEMA)


def test_rolling_forecast_ignores_the_future(spark):
    panel = random_walks(spark)
    best = best_for(spark, "ab", (1, 1, 0, 0, 0, 0))
    got = fc.rolling_forecasts(panel, best, "key", "ts", "value", 6).toPandas().sort_values(["key", "ts"])
    assert len(got) == 12
    cut = got["ts"].unique()[3]
    changed = panel.withColumn("value", F.when(F.col("ts") >= F.lit(cut), F.col("value") * 100).otherwise(F.col("value")))
    again = fc.rolling_forecasts(changed, best, "key", "ts", "value", 6).toPandas().sort_values(["key", "ts"])
    early = (got["ts"] <= cut).to_numpy()
    assert got["predicted"].to_numpy()[early] == pytest.approx(again["predicted"].to_numpy()[early])
    assert not np.allclose(got["predicted"].to_numpy()[~early], again["predicted"].to_numpy()[~early])


def test_recursive_forecast_ignores_all_test_rows(spark):
    panel = random_walks(spark)
    best = best_for(spark, "ab", (1, 1, 0, 0, 0, 0))
    got = fc.rolling_forecasts(panel, best, "key", "ts", "value", 3, horizon=3).toPandas().sort_values(["key", "ts"])
    last = months(48)[45]
    changed = panel.withColumn("value", F.when(F.col("ts") >= F.lit(last), F.lit(0.0)).otherwise(F.col("value")))
    again = fc.rolling_forecasts(changed, best, "key", "ts", "value", 3, horizon=3).toPandas().sort_values(["key", "ts"])
    assert len(got) == 6
    assert got["predicted"].to_numpy() == pytest.approx(again["predicted"].to_numpy())


def test_search_skips_failures_and_falls_back(spark):
    panel = random_walks(spark, 8)
    got = fc.search_orders(panel, "key", "ts", "value", [(2, 2, 2, 2, 2, 2)]).collect()
    assert {(r["p"], r["d"], r["q"], r["sp"], r["sd"], r["sq"], r["aic"]) for r in got} == {(*fc.FALLBACK, None)}
    some = fc.search_orders(random_walks(spark), "key", "ts", "value", [(2, 2, 2, 2, 2, 2), (0, 1, 0, 0, 0, 0)]).collect()
    assert all(r["d"] == 1 and r["aic"] is not None for r in some)


def test_cv_folds_match_the_split(spark):
    panel = random_walks(spark, 40)
    got = fc.rolling_cv(panel, best_for(spark, "ab", (0, 1, 0, 0, 0, 0)), "key", "ts", "value").toPandas()
    values = panel.toPandas().sort_values(["key", "ts"])
    for k, part in values.groupby("key"):
        v = part["value"].to_numpy()
        for fold in range(5):
            idx = np.arange(40 - (5 - fold) * 6, 40 - (4 - fold) * 6)
            want = np.sqrt(np.mean((v[idx] - v[idx - 1]) ** 2))
            row = got[(got["key"] == k) & (got["fold"] == fold)].iloc[0]
            assert row["rmse"] == pytest.approx(want)


def test_hybrid_adds_its_residual_forecast(spark):
    panel = random_walks(spark)
    best = best_for(spark, "ab", (1, 1, 0, 0, 0, 0))
    forecasts = fc.rolling_forecasts(panel, best, "key", "ts", "value", 3)
    train = panel.filter(F.col("ts") < F.lit(months(48)[45]))
    residuals = fc.residual_table(train, best, "key", "ts", "value")
    got = fc.hybrid_forecasts(forecasts, residuals, "key", "ts", trees=3).toPandas()
    assert len(got) == 6 and got["residual_forecast"].notna().all()
    assert got["hybrid"].to_numpy() == pytest.approx((got["predicted"] + got["residual_forecast"]).to_numpy())
