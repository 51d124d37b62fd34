"""The method matrix: cells that cannot differ share rankings, rows are not copied per cell."""

import itertools

import numpy as np
import pandas as pd
import pytest

from terralag.operators import compare, correlation
from terralag.operators.quantiles import exact_quantiles
from test_plans import plan_of


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(300), "a": rng.integers(0, 30, 300) * 1.0, "b": rng.normal(size=300), "y": rng.normal(size=300)})
    pdf.loc[::9, "a"], pdf.loc[::7, "b"], pdf.loc[::11, "y"] = np.nan, np.nan, np.nan
    pdf.loc[5, "b"], pdf.loc[8, "a"] = 50.0, 900.0
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double"), pdf


def test_cells_against_pandas(frame):
    df, pdf = frame
    methods = ("none", "winsorize", "iqr_nan", "iqr_drop")
    got = {(r[0], r[1]): (r[2], r[3]) for r in compare.method_matrix(df, "id", ["a", "b", "y"], "y", methods).collect()}
    for m, f in itertools.product(methods, compare.FILL_METHODS):
        part = pdf[["a", "b", "y"]].copy()
        for c in ("a", "b"):
            if m == "winsorize":
                part[c] = part[c].clip(*part[c].quantile([0.05, 0.95]))
            elif m != "none":
                q1, q3 = part[c].quantile([0.25, 0.75])
                inside = part[c].between(q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1))
                part = part[inside] if m == "iqr_drop" else part.assign(**{c: part[c].where(inside)})
        if f != "none":
            part = part.fillna(getattr(part, f)())
        part = part[part["y"].notna()]
        want = np.mean([abs(part[["y", c]].dropna().rank().corr().iloc[0, 1]) for c in ("a", "b")])
        assert got[(m, f)] == (pytest.approx(want, abs=1e-12), len(part)), (m, f)


def test_rows_are_not_copied_per_cell(frame, monkeypatch):
    """Before, each row became 63 rows, and medians were taken for columns without gaps."""
    df, _ = frame
    asked = []
    monkeypatch.setattr(compare, "exact_quantiles", lambda data, exprs, probs: asked.append(len(exprs)) or exact_quantiles(data, exprs, probs))
    full = df.na.fill(0.0, ["b", "y"])
    got = compare.method_matrix(full, "id", ["a", "b", "y"], "y", ("none", "winsorize"))
    assert asked == [2]
    plan = plan_of(got)
    assert "MapInArrow" in plan or "PythonMapInArrow" in plan
    assert len(got.collect()) == 6


def test_equal_numbers_of_kept_rows_are_not_equal_rows(spark):
    """Two methods that drop as many rows need not drop the same ones."""
    rows = [(i, float(i % 5), float(i % 7), float(i)) for i in range(100)]
    df = spark.createDataFrame([*rows, (100, 900.0, 1.0, 3.0), (101, 1.0, 2.0, 4.0)], "id long, a double, b double, y double")
    both = compare.method_matrix(df, "id", ["a", "b", "y"], "y", ("iqr", "iqr_drop"), ("none",)).collect()
    for m in ("iqr", "iqr_drop"):
        alone = compare.method_matrix(df, "id", ["a", "b", "y"], "y", ("none", m), ("none",)).where(f"outlier_method = '{m}'").first()
        assert alone in both


def test_pair_correlations(spark):
    rows = [(1.0, 2.0, 7.0), (2.0, 1.0, 7.0), (4.0, None, 7.0), (3.0, 5.0, 7.0)]
    df = spark.createDataFrame(rows, "x double, y double, k double").repartition(3)
    got = {r.pair: r.rho for r in correlation.pair_correlations(df, [(0, 1), (0, 2), (1, 1)], shift=2.0).collect()}
    assert got[0] == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1])
    assert got[1] is None and got[2] == pytest.approx(1.0)
