"""Physical plans: no cross products, no unbounded single-task windows, filters at the scan."""

import re

import pytest
from pyspark.sql import functions as F

from terralag.operators import ordered
from terralag.operators.correlation import spearman_matrix
from terralag.operators.nearest import nearest_join
from terralag.plans import tables as t
from terralag.plans.catalogue import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


CHEAP = [
    "A4_parquet_scan", "B5_within_time_range", "C1_rate_join", "C2_volatility_join", "C5_nearest_pixel", "C6_label_pixels",
    "C8_grid_snap_join", "C11_reindex_forward_fill", "C13_parameter_product", "D14_spearman_matrix", "D17_cross_correlation",
    "D20_density_curve", "E1_fill_both_ways", "E3_monthly_volatility", "E7_month_end_series", "H1_iqr_sequential",
    "I3_nearest_fill_5", "L10_method_matrix", "M4_rolling_forecast", "feature_table_by_group",
]


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_products(spark, data, name):
    plan = plan_of(QUERIES[name](spark, data))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_long_order_windows_are_bucketed(spark, data):
    rows = t.prices(spark, data)
    for df in (
        ordered.previous_row(rows, ["venda"], "row_id", rows_per_bucket=100),
        ordered.fill_both_ways(rows, ["compra"], "row_id", rows_per_bucket=100),
        ordered.row_position(rows, "row_id", rows_per_bucket=100),
    ):
        plan = plan_of(df)
        # the wide rows are windowed per bucket; only the carry table (a row per bucket) is not
        wide = [line for line in plan.splitlines() if "Window" in line and "_bucket" in line]
        assert wide
        assert plan.count("Exchange SinglePartition") <= 1


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = formatted(QUERIES["A4_parquet_scan"](spark, data))
    assert "GreaterThan(l_quantity,45.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "l_tax" not in schema and "l_shipdate" not in schema
    bounded = plan_of(QUERIES["H7_iqr_joint"](spark, data))
    assert "PushedFilters" in bounded


def test_wide_payload_is_joined_after_the_search(spark, data):
    got = nearest_join(t.points(spark, data), t.pixels(spark, data), "point_id", "pixel_id", ("px", "py"), ("x", "y"))
    assert {"pixel_id", "B08", "distance"} <= set(got.columns)


def test_rank_matrix_aggregates_once(spark, data):
    plan = plan_of(spearman_matrix(t.dense(spark, data), t.FRAME))
    assert "CartesianProduct" not in plan


def test_workers_need_no_installed_package(spark):
    from terralag.operators.stationarity import adf_p_value

    out = spark.range(2).select(F.pandas_udf(lambda s: s.map(lambda v: adf_p_value(-float(v))), "double")("id")).collect()
    assert len(out) == 2


@pytest.mark.parametrize("name", ["C1_rate_join", "D19_histogram_by_group"])
def test_small_sides_are_sent_out_by_count(spark, data, name):
    """Whatever Spark estimates, the long side is not shuffled to meet one row per month or group."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, data))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan
    if name == "C1_rate_join":
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
