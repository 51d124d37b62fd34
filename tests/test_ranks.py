"""Rank tables: one sort of the distinct values for all groups, short tables sent out."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralag.operators import correlation, ordered
from test_plans import plan_of


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(float(i * 37 % 101), None if i % 7 == 0 else float(i * 53 % 89), None if i % 5 == 0 else float(i % 4)) for i in range(400)]
    rows += [(None, 3.0, 1.0), (None, None, None), (5.0, -2.0, None)]
    return spark.createDataFrame(rows, "x double, y double, z double"), pd.DataFrame(rows, columns=["x", "y", "z"], dtype=float)


@pytest.mark.parametrize("size", [10**6, 20])
def test_all_gaps_are_ranked_by_one_sort(gaps, size):
    """Before, each distinct value was copied once per group and shuffled again for the join of its ranks."""
    df, pdf = gaps
    groups = [(F.lit(True), None), (F.col("y").isNotNull(), None), (F.col("z").isNotNull(), None), (F.col("x") < 50, None)]
    ranks = correlation.conditional_ranks(df, "x", groups, size)
    assert "Generate" not in plan_of(ranks)
    got = {r["v"]: r["ranks"] for r in ranks.collect()}
    assert None not in got and len(got) == pdf["x"].nunique()
    for i, rows in enumerate([pdf["x"].notna(), pdf["y"].notna(), pdf["z"].notna(), pdf["x"] < 50]):
        want = pdf[rows].assign(r=lambda d: d["x"].rank()).dropna(subset=["x"]).groupby("x")["r"].first()
        assert {v: r[i] for v, r in got.items() if r[i] is not None} == want.to_dict()


def test_short_rank_tables_are_sent_out(spark, gaps):
    """The rows are not shuffled by a column of few values, and those take no scans for bucket edges."""
    df, pdf = gaps
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = correlation.spearman_matrix(df, ["x", "y", "z"])
        assert "SortMergeJoin" not in plan_of(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for r in got.collect():
        pair = pdf[[r["a"], r["b"]]].dropna().rank()
        assert r["rho"] == pytest.approx(pair[r["a"]].corr(pair[r["b"]]), abs=1e-12)


@pytest.mark.parametrize("size", [10**6, 30])
def test_several_running_totals(gaps, size):
    df, pdf = gaps
    rows = df.groupBy("x").agg(F.count("y").alias("ny"), F.count("z").alias("nz")).where("x IS NOT NULL")
    got = ordered.running_totals(rows, {"by": "ny", "bz": "nz"}, "x", rows_per_bucket=size).orderBy("x").toPandas()
    for total, n in (("by", "ny"), ("bz", "nz")):
        assert (got[total] == got[n].cumsum() - got[n]).all()
