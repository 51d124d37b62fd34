"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and once for the clock, writing its rows to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terralag.plans.catalogue import QUERIES  # noqa: E402
from terralag.session import build_session  # noqa: E402

HEADLINE = [
    "A4_parquet_scan",
    "A8_tile_explode",
    "C1_rate_join",
    "C5_nearest_pixel",
    "C6_label_pixels",
    "C8_grid_snap_join",
    "D2_monthly_mean_by_product",
    "D8_describe",
    "D11_exact_quantiles",
    "D14_spearman_matrix",
    "D14_spearman_matrix_no_gaps",
    "D19_histogram",
    "E1_fill_both_ways",
    "E3_monthly_volatility",
    "E7_month_end_series",
    "E9_decomposition_by_product",
    "E10_unit_root_test",
    "G1_ndvi",
    "H1_iqr_sequential",
    "H3_iqr_to_null",
    "H6_winsorize",
    "I2_median_fill",
    "I3_nearest_fill_5",
    "I3_nearest_fill_10",
    "I3_nearest_fill_wide",
    "I4_iterative_fill",
    "J4_quantile_normal",
    "J10_forward_selection",
    "J10_forward_selection_linear_all",
    "K2_random_forest",
    "L2_grid_search",
    "L5_cross_validate_mean",
    "L6_subset_search_linear_grid",
    "L10_method_matrix",
    "M1_order_search",
    "M1_seasonal_products",
    "M4_rolling_forecast",
    "M6_hybrid_forecast",
    "feature_table_by_group",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "terralag-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
