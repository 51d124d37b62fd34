"""Long-order windows and exact quantiles with tiny buckets, so that every edge is crossed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralag.operators import ordered, quantiles
from terralag.operators.correlation import average_ranks, correlation_p_value, spearman_by_group, spearman_matrix
from terralag.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 400
    pdf = pd.DataFrame(
        {
            "id": rng.permutation(n),
            "k": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n)),
            "v": np.round(rng.normal(size=n), 2),
        }
    )
    pdf["day"] = np.where(rng.random(n) < 0.35, 5, rng.integers(0, 20, n))
    pdf["gap"] = pdf["v"].where(rng.random(n) < 0.3)
    return spark.createDataFrame(pdf).withColumn("gap", F.when(~F.isnan("gap"), F.col("gap"))), pdf


def test_bucket_sizes_and_hot_value(rows):
    df, _ = rows
    sizes = ordered.with_bucket(df, "day", tie="id", rows_per_bucket=20).groupBy("_bucket").count().toPandas()
    assert sizes["count"].max() <= 60


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_previous_row(rows, keys):
    df, pdf = rows
    got = ordered.previous_row(df, ["v"], "day", keys, tie="id", rows_per_bucket=20).toPandas().set_index("id")["prev_v"]
    p = pdf.sort_values(["day", "id"])
    want = (p.groupby(keys[0])["v"] if keys else p["v"]).shift(1)
    want.index = p["id"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_fill_both_ways(rows, keys):
    df, pdf = rows
    got = ordered.fill_both_ways(df, ["gap"], "id", keys, rows_per_bucket=20).toPandas().set_index("id")["gap"]
    p = pdf.sort_values("id")
    if keys:
        want = p.groupby("k")["gap"].transform(lambda s: s.ffill().bfill())
    else:
        want = p["gap"].ffill().bfill()
    want.index = p["id"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_row_position(rows):
    df, pdf = rows
    got = ordered.row_position(df, "id", rows_per_bucket=20).toPandas()
    assert (got["position"] == got["id"]).all()


def test_average_ranks(rows):
    df, pdf = rows
    got = average_ranks(df, "v", "rank", rows_per_bucket=20).toPandas().set_index("v")["rank"]
    want = pdf["v"].rank()
    assert (got.loc[pdf["v"]].to_numpy() == want.to_numpy()).all()


def test_spearman_with_ties_and_gaps(spark, rows):
    small = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (2.0, 4.0), (3.0, 4.0)], "x double, y double")
    assert spearman_matrix(small, ["x", "y"]).first()["rho"] == pytest.approx(0.5)
    df, pdf = rows
    got = spearman_matrix(df, ["v", "gap", "day"], rows_per_bucket=25).toPandas()
    for _, r in got.iterrows():
        pair = pdf[[r["a"], r["b"]]].dropna().rank()
        assert r["rho"] == pytest.approx(pair[r["a"]].corr(pair[r["b"]]), abs=1e-12)
    assert len(got) == 3


def test_spearman_of_constant_is_null(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 3.0)], "g int, x double, y double")
    assert spearman_by_group(df, "g").first()["rho"] is None


def test_p_values():
    # r = 0.5, n = 10: t = 1.632993, two-sided p with 8 degrees of freedom
    assert correlation_p_value(0.5, 10) == pytest.approx(0.1411132813, abs=1e-9)
    assert correlation_p_value(0.0, 30) == pytest.approx(1.0)
    assert correlation_p_value(1.0, 5) == 0.0
    assert correlation_p_value(0.3, 2) is None


@pytest.mark.parametrize("limit,small", [(10**6, 10**6), (10**6, 0), (30, 10**6)])
def test_exact_quantiles(rows, spark, monkeypatch, limit, small):
    monkeypatch.setattr(quantiles, "PERCENTILE_LIMIT", small)
    df, pdf = rows
    probs = [0.0, 0.05, 0.25, 0.5, 0.731, 0.95, 1.0]
    got = exact_quantiles(df, ["v", "day", "gap"], probs, limit=limit)
    for c in got:
        assert got[c] == pytest.approx(np.nanquantile(pdf[c].to_numpy(float), probs), abs=1e-12)


def test_many_quantiles_of_tied_values(rows, spark):
    df, pdf = rows
    probs = [i / 99 for i in range(100)]
    got = exact_quantiles(df, ["day", "v"], probs)
    for c in got:
        assert got[c] == pytest.approx(np.quantile(pdf[c].to_numpy(float), probs), abs=1e-12)


def test_quantiles_of_a_small_list(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 7, 11, 16)], "x double")
    assert exact_quantiles(df, ["x"], [0.25, 0.75])["x"] == [2.5, 10.0]


def test_quantiles_dominated_by_one_value(spark):
    values = [3.0] * 500 + [float(i) for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, ["x"], [0.01, 0.5, 0.9, 0.999], limit=20)["x"]
    assert got == pytest.approx(np.quantile(values, [0.01, 0.5, 0.9, 0.999]))


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [None]


def test_quantile_jobs_do_not_grow_with_the_quantiles(rows, spark):
    df, _ = rows
    jobs = []
    for n in (2, 100):
        spark.sparkContext.setJobGroup(f"quantiles-{n}", "")
        exact_quantiles(df, ["v", "day"], [i / (n - 1) for i in range(n)], limit=100)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"quantiles-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_buckets_have_no_cap(rows, monkeypatch):
    monkeypatch.setattr(ordered, "LEVEL_BUCKETS", 4)
    df, pdf = rows
    sizes = ordered.with_bucket(df, "id", rows_per_bucket=20).groupBy("_bucket").count().toPandas()
    assert sizes["count"].max() <= 60 and len(sizes) > 4
    got = ordered.row_position(df, "day", rows_per_bucket=20, tie="id").toPandas().set_index("id")["position"].sort_index()
    want = pdf.sort_values(["day", "id"]).reset_index(drop=True)
    assert got.tolist() == pd.Series(want.index, index=want["id"]).sort_index().tolist()
