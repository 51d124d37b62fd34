"""Aggregation, profiling, correlation and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralag.functions import metrics as m
from terralag.functions import scalars as s
from terralag.operators import correlation as corr
from terralag.operators import profile as prof
from terralag.operators import relational as rel
from terralag.operators import series as ser
from terralag.operators.quantiles import exact_quantiles
from terralag.plans import tables as t
from terralag.plans.ingest import FX_SQL, PANEL_SQL, RATIO_SQL, fx_monthly, r
from terralag.plans.registry import query
from terralag.plans.tables import table


def day(c: str):
    return F.col(c).cast("string").alias(c)


@query(
    "D1_daily_site_mean",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, round(avg(value * 1.0 / 7), 6) AS temp FROM events GROUP BY 1, 2""",
)
def daily_site_mean(spark, d):
    rows = table(spark, d, "events").withColumn("temp", F.col("value") / 7)
    return ser.daily_mean(rows, "ts", "temp", ["user_id"]).select(day("day"), "user_id", r("temp").alias("temp"))


@query(
    "D2_monthly_mean_by_product",
    f"SELECT produto, CAST(month_end AS VARCHAR) AS month_end, round(venda, 6) AS venda FROM {PANEL_SQL}",
)
def monthly_product_mean(spark, d):
    got = ser.monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    return got.select("produto", day("month_end"), r("venda").alias("venda"))


@query(
    "D3_monthly_mean",
    f"SELECT CAST(last_day(data) AS VARCHAR) AS month_end, round(avg(venda), 6) AS venda FROM {t.PRICES_SQL} GROUP BY 1",
)
def monthly_mean(spark, d):
    got = ser.monthly_mean(t.prices(spark, d), "data", ["venda"])
    return got.select(day("month_end"), r("venda").alias("venda"))


@query(
    "D4_monthly_std_by_product",
    f"""SELECT produto, CAST(last_day(data) AS VARCHAR) AS month_end, round(stddev_samp(venda), 6) AS venda
    FROM {t.PRICES_SQL} GROUP BY 1, 2""",
)
def monthly_product_std(spark, d):
    got = ser.monthly_std(t.prices(spark, d), "data", "venda", ["produto"])
    return got.select("produto", day("month_end"), r("venda").alias("venda"))


@query(
    "D5_pivot_ratio",
    f"""SELECT CAST(month_end AS VARCHAR) AS month_end, round(top, 6) AS urgent, round(bottom, 6) AS low,
    round(top / NULLIF(bottom, 0) * 100, 6) AS ratio_percent FROM {RATIO_SQL}""",
)
def pivot_ratio(spark, d):
    rows = t.prices(spark, d).withColumn("month_end", s.month_end(F.col("data")))
    got = ser.pivot_ratio(rows, "month_end", "produto", "venda", "1-URGENT", "5-LOW", t.PRODUCTS)
    return got.select(
        day("month_end"), r("1-URGENT").alias("urgent"), r("5-LOW").alias("low"), r("ratio_percent").alias("ratio_percent")
    )


DISTINCT_OF = ["l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]


@query(
    "D6_distinct_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in DISTINCT_OF),
)
def distinct_counts(spark, d):
    return prof.distinct_counts(table(spark, d, "lineitem"), DISTINCT_OF)


@query("D7_distinct_values", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_values(spark, d):
    return table(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()


def _union(template: str, columns, **extra) -> str:
    return " UNION ALL ".join(template.format(c=c, **extra) for c in columns)


@query(
    "D8_describe",
    _union(
        "SELECT '{c}' AS \"column\", unnest(['count','mean','std','min','25%','50%','75%','max']) AS stat, "
        "round(unnest([count({c})::DOUBLE, avg({c}), stddev_samp({c}), min({c}), quantile_cont({c}, 0.25), "
        "quantile_cont({c}, 0.5), quantile_cont({c}, 0.75), max({c})]), 4) AS value FROM {f}",
        t.FRAME,
        f=t.FRAME_SQL,
    ),
)
def describe(spark, d):
    return prof.describe(t.frame(spark, d), t.FRAME).select("column", "stat", r("value", 4).alias("value"))


@query(
    "D9_missing_shares",
    _union(
        "SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing, "
        "round(count(*) FILTER ({c} IS NULL) / count(*), 8) AS share FROM {f}",
        t.FRAME,
        f=t.FRAME_SQL,
    ),
)
def missing_shares(spark, d):
    return prof.missing(t.frame(spark, d), t.FRAME).select("column", "n_missing", r("share", 8).alias("share"))


@query("D10_column_std", _union("SELECT '{c}' AS \"column\", round(stddev_samp({c}), 5) AS std FROM {f}", t.FRAME, f=t.FRAME_SQL))
def column_std(spark, d):
    return prof.spreads(t.frame(spark, d), t.FRAME).select("column", r("std", 5).alias("std"))


def _scalar_rows(spark, rows, schema):
    """A small report of driver scalars as a table."""
    return spark.createDataFrame(rows, schema)


QUANTILES_SQL = _union(
    "SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.05), 6) AS q05, round(quantile_cont({c}, 0.25), 6) AS q25, "
    "round(quantile_cont({c}, 0.75), 6) AS q75, round(quantile_cont({c}, 0.95), 6) AS q95 FROM {f}",
    t.FRAME,
    f=t.FRAME_SQL,
)


def _quantiles(spark, d, **limits):
    got = exact_quantiles(t.frame(spark, d), t.FRAME, [0.05, 0.25, 0.75, 0.95], **limits)
    rows = _scalar_rows(spark, [(c, *q) for c, q in got.items()], "column string, q05 double, q25 double, q75 double, q95 double")
    return rows.select("column", *[r(q).alias(q) for q in ("q05", "q25", "q75", "q95")])


@query("D11_exact_quantiles", QUANTILES_SQL)
def quantiles(spark, d):
    return _quantiles(spark, d)


@query("D11_exact_quantiles_three_scans", QUANTILES_SQL)
def quantiles_three_scans(spark, d):
    """The way of large columns, whatever the size."""
    return _quantiles(spark, d, limit=100)


@query(
    "D12_median_mad",
    _union(
        "SELECT '{c}' AS \"column\", round(any_value(m), 6) AS median, "
        "round(quantile_cont(abs({c} - m), 0.5) / 0.6744897501960817, 6) AS mad "
        "FROM {f}, (SELECT quantile_cont({c}, 0.5) AS m FROM {f})",
        t.FRAME,
        f=t.FRAME_SQL,
    ),
)
def median_mad(spark, d):
    got = prof.medians_and_mads(t.frame(spark, d), t.FRAME)
    rows = _scalar_rows(spark, [(c, *v) for c, v in got.items()], "column string, median double, mad double")
    return rows.select("column", r("median").alias("median"), r("mad").alias("mad"))


def _pairs(columns):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


@query(
    "D13_pearson_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {t.FRAME_SQL}" for a, b in _pairs(t.FRAME)
    ),
)
def pearson_matrix(spark, d):
    return corr.pearson_matrix(t.frame(spark, d), t.FRAME).select("a", "b", r("r").alias("r"))


def spearman_sql(source: str, x: str, y: str) -> str:
    """Average-rank correlation of two columns, complete pairs only."""
    return f"""(SELECT corr(rx, ry) AS rho, count(*) AS n FROM (SELECT
        rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
        rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
        FROM (SELECT {x} AS x, {y} AS y FROM {source}) WHERE x IS NOT NULL AND y IS NOT NULL))"""


SPEARMAN_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(rho, 6) AS rho FROM {spearman_sql(t.FRAME_SQL, a, b)}" for a, b in _pairs(t.FRAME)
)


@query("D14_spearman_matrix", SPEARMAN_SQL)
def spearman_matrix(spark, d):
    return corr.spearman_matrix(t.frame(spark, d), t.FRAME).select("a", "b", r("rho").alias("rho"))


@query("D14_spearman_matrix_small_buckets", SPEARMAN_SQL)
def spearman_matrix_small_buckets(spark, d):
    return corr.spearman_matrix(t.frame(spark, d), t.FRAME, rows_per_bucket=500).select("a", "b", r("rho").alias("rho"))


@query(
    "D14_spearman_matrix_no_gaps",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(rho, 6) AS rho FROM {spearman_sql(t.DENSE_SQL, a, b)}" for a, b in _pairs(t.FRAME)
    ),
)
def spearman_matrix_dense(spark, d):
    return corr.spearman_matrix(t.dense(spark, d), t.FRAME).select("a", "b", r("rho").alias("rho"))


LAGGED_SQL = f"(SELECT venda, lag(compra) OVER (ORDER BY row_id) AS prev FROM {t.PRICES_SQL} WHERE venda IS NOT NULL AND compra IS NOT NULL)"


@query(
    "D15_spearman_test",
    f"SELECT round(rho, 6) AS rho, n FROM {spearman_sql(LAGGED_SQL, 'venda', 'prev')}",
)
def spearman_lagged(spark, d):
    """Sale price against the purchase price one row earlier in table order."""
    from terralag.operators.ordered import previous_row

    rows = t.prices(spark, d).dropna(subset=["venda", "compra"])
    got = corr.spearman_test(previous_row(rows, ["compra"], "row_id"), "venda", "prev_compra")
    return got.select(r("rho").alias("rho"), "n")


@query("D15_spearman_p_value")
def spearman_p_value(spark, d):
    got = corr.spearman_test(t.keyed(spark, d), "a", "c")
    return got.select(r("rho").alias("rho"), r("p_value", 8).alias("p_value"), "n")


@query(
    "D16_average_rank_correlation",
    "SELECT round(avg(abs(rho)), 6) AS avg_abs_corr_with_target FROM ("
    + " UNION ALL ".join(f"SELECT rho FROM {spearman_sql(t.FRAME_SQL, c, 'price')}" for c in ("qty", "disc", "tax"))
    + ")",
)
def average_rank_correlation(spark, d):
    rho = corr.spearman_with_target(t.frame(spark, d), ["qty", "disc", "tax"], "price")
    return corr.average_absolute(rho).select(r("avg_abs_corr_with_target").alias("avg_abs_corr_with_target"))


PANEL_FX_SQL = f"""(SELECT produto, month_end, venda, compra, dol_val FROM {PANEL_SQL}
    LEFT JOIN (SELECT last_day(month) AS month_end, dol_val FROM {FX_SQL}) USING (month_end))"""


def panel_fx(spark, d):
    """Monthly panel with the exchange rate of the month."""
    panel = ser.monthly_mean(t.prices(spark, d), "data", ["venda", "compra"], ["produto"])
    fx = fx_monthly(spark, d).select(F.last_day("month").alias("month_end"), "dol_val")
    return panel.join(fx, "month_end", "left")


@query(
    "D17_cross_correlation",
    " UNION ALL ".join(
        f"SELECT produto, {k} AS lag, round(corr(v, dol_val), 6) AS r FROM (SELECT produto, dol_val, "
        f"lag(venda, {k}) OVER (PARTITION BY produto ORDER BY month_end) AS v FROM {PANEL_FX_SQL}) GROUP BY produto"
        for k in range(1, 13)
    ),
)
def cross_correlation(spark, d):
    got = corr.cross_correlation(panel_fx(spark, d), "produto", "month_end", "venda", "dol_val")
    return got.select("produto", F.col("lag").cast("bigint").alias("lag"), r("r").alias("r"))


@query(
    "D18_component_correlation",
    f"""WITH c AS (SELECT * FROM (SELECT produto, lag(venda, 1) OVER w AS a1, lag(venda, 2) OVER w AS a2, dol_val
        FROM {PANEL_FX_SQL} WINDOW w AS (PARTITION BY produto ORDER BY month_end))
        WHERE a1 IS NOT NULL AND a2 IS NOT NULL AND dol_val IS NOT NULL)
    SELECT produto, 'AR(1)' AS a, 'AR(2)' AS b, round(corr(a1, a2), 6) AS r FROM c GROUP BY produto
    UNION ALL SELECT produto, 'AR(1)', 'dol_val', round(corr(a1, dol_val), 6) FROM c GROUP BY produto
    UNION ALL SELECT produto, 'AR(2)', 'dol_val', round(corr(a2, dol_val), 6) FROM c GROUP BY produto""",
)
def component_correlation(spark, d):
    got = corr.component_correlation(panel_fx(spark, d), "produto", "month_end", "venda", "dol_val")
    return got.select("produto", "a", "b", r("r").alias("r"))


def histogram_sql(source: str, c: str, bins: int, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    ends = f"SELECT {keys}min({c}) AS lo, max({c}) AS hi FROM {source} WHERE {c} IS NOT NULL" + (f" GROUP BY {by}" if by else "")
    return f"""WITH h AS (SELECT {keys}CAST(least(floor(({c} - lo) / ((hi - lo) / {bins}.0)), {bins} - 1) AS BIGINT) AS bin, count(*) AS n
        FROM (SELECT *, min({c}) OVER ({over}) AS lo, max({c}) OVER ({over}) AS hi FROM {source} WHERE {c} IS NOT NULL)
        GROUP BY ALL)
        SELECT {keys}bin, coalesce(n, 0) AS n FROM (SELECT {keys}bin FROM ({ends}), range(0, {bins}) r(bin)) LEFT JOIN h USING ({keys}bin)"""


@query("D19_histogram", histogram_sql(t.FRAME_SQL, "price", 30))
def histogram(spark, d):
    return prof.histogram(t.frame(spark, d), "price", 30)


@query("D19_histogram_by_group", histogram_sql(t.PRICES_SQL, "venda", 20, "sigla_uf, produto"))
def histogram_by_group(spark, d):
    return prof.histogram(t.prices(spark, d), "venda", 20, ["sigla_uf", "produto"])


@query(
    "D20_density_curve",
    f"""WITH v AS (SELECT venda AS v FROM {t.PRICES_SQL}),
    s AS (SELECT count(v) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM v),
    h AS (SELECT lo + (least(floor((v - lo) / ((hi - lo) / 400.0)), 399) + 0.5) * ((hi - lo) / 400) AS c, count(*) AS k
      FROM v, s GROUP BY 1),
    g AS (SELECT lo + i * ((hi - lo) / 49) AS x, n, sd * power(n, -0.2) AS bw FROM s, range(0, 50) t(i))
    SELECT round(x, 6) AS x, round(sum(k * exp(-((x - c) / bw) * ((x - c) / bw) / 2)) / any_value(n * bw * sqrt(2 * pi())), 6) AS density
    FROM g, h GROUP BY x""",
)
def density_curve(spark, d):
    return prof.kde(t.prices(spark, d), "venda").select(r("x").alias("x"), r("density").alias("density"))


@query(
    "D21_box_statistics",
    _union(
        "SELECT '{c}' AS \"column\", round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3, "
        "round(least(min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1)), any_value(q1)), 6) AS low_whisker, "
        "round(greatest(max({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1)), any_value(q3)), 6) AS high_whisker, "
        "count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_fliers "
        "FROM {f}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {f})",
        t.FRAME,
        f=t.FRAME_SQL,
    ),
)
def box_statistics(spark, d):
    got = prof.box_stats(t.frame(spark, d), t.FRAME)
    return got.select("column", *[r(c).alias(c) for c in ("q1", "median", "q3", "low_whisker", "high_whisker")], "n_fliers")


PREDICTED_SQL = """(SELECT o_orderpriority AS model, o_orderkey % 5 AS fold, o_totalprice / 70000 AS y,
    o_totalprice / 70000 + (o_custkey % 200 - 100) / 500.0 AS p FROM orders)"""


def predicted(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderpriority AS model",
        "o_orderkey % 5 AS fold",
        "o_totalprice / 70000 AS y",
        "o_totalprice / 70000 + (o_custkey % 200 - 100) / 500.0 AS p",
    )


METRIC_SQL = """round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
    round(100 * avg(abs((y - p) / NULLIF(y, 0))), 5) AS mape_percent,
    round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2"""


@query("D22_regression_metrics", f"SELECT model, {METRIC_SQL} FROM {PREDICTED_SQL} GROUP BY model")
def regression_metrics(spark, d):
    got = m.evaluate(predicted(spark, d), "y", "p", ["model"])
    return got.select("model", r("rmse").alias("rmse"), r("mae").alias("mae"), r("mape_percent", 5).alias("mape_percent"), r("r2").alias("r2"))


@query("D23_mape_with_epsilon", f"SELECT round(100 * avg(abs((y - p) / (y + 1e-8))), 5) AS mape_percent_eps FROM {PREDICTED_SQL}")
def mape_with_epsilon(spark, d):
    got = m.evaluate(predicted(spark, d), "y", "p", metrics=["mape_percent_eps"])
    return got.select(r("mape_percent_eps", 5).alias("mape_percent_eps"))


FOLDS_SQL = f"(SELECT model, fold, {METRIC_SQL} FROM {PREDICTED_SQL} GROUP BY model, fold)"


@query(
    "D24_fold_mean_and_spread",
    f"""SELECT model, round(avg(rmse), 4) AS rmse_mean, round(stddev_pop(rmse), 4) AS rmse_std, round(avg(r2), 4) AS r2_mean,
    round(stddev_pop(r2), 4) AS r2_std FROM {FOLDS_SQL} GROUP BY model""",
)
def fold_mean_and_spread(spark, d):
    folds = m.evaluate(predicted(spark, d), "y", "p", ["model", "fold"])
    got = m.fold_summary(folds, ["rmse", "r2"], ["model"])
    return got.select("model", *[r(c, 4).alias(c) for c in ("rmse_mean", "rmse_std", "r2_mean", "r2_std")])


@query(
    "D25_model_report",
    f"""SELECT model, round(avg(r2), 4) AS r2, round(avg(rmse), 4) AS rmse, round(avg(mape_percent), 3) AS mape,
    CASE WHEN avg(r2) >= 0.7 THEN 'good' ELSE 'poor' END AS classification FROM {FOLDS_SQL} GROUP BY model ORDER BY 2 DESC""",
)
def model_report(spark, d):
    from terralag.operators.tuning import classify_models

    folds = m.evaluate(predicted(spark, d), "y", "p", ["model", "fold"]).withColumnRenamed("mape_percent", "mape")
    got = classify_models(folds)
    return got.select("model", r("r2", 4).alias("r2"), r("rmse", 4).alias("rmse"), r("mape", 3).alias("mape"), "classification")


@query(
    "D26_stage_counts",
    f"""SELECT 'raw' AS stage, count(*) AS n_rows, 5 AS n_columns FROM {t.FRAME_SQL}
    UNION ALL SELECT 'complete', count(*), 5 FROM {t.FRAME_SQL} WHERE qty IS NOT NULL AND tax IS NOT NULL
    UNION ALL SELECT 'cheap', count(*), 2 FROM {t.FRAME_SQL} WHERE price < 50000""",
)
def stage_counts(spark, d):
    raw = t.frame(spark, d)
    stages = {"raw": raw, "complete": raw.dropna(), "cheap": raw.filter("price < 50000").select("okey", "price")}
    return rel.stage_counts(stages)


# ---- sequences


GAPPED_SQL = f"(SELECT row_id, produto, CASE WHEN row_id % 5 < 2 THEN NULL ELSE venda END AS v FROM {t.PRICES_SQL})"


def gapped(spark, d):
    return t.prices(spark, d).select("row_id", "produto", F.expr("CASE WHEN row_id % 5 < 2 THEN NULL ELSE venda END").alias("v"))


def fill_sql(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT row_id, round(coalesce(last_value(v IGNORE NULLS) OVER ({part} ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(v IGNORE NULLS) OVER ({part} ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS v FROM {GAPPED_SQL}"""


@query("E1_fill_both_ways", fill_sql(""))
def fill_file_order(spark, d):
    return ser.fill_missing(gapped(spark, d), ["v"], "row_id").select("row_id", r("v").alias("v"))


@query("E1_fill_both_ways_small_buckets", fill_sql(""))
def fill_small_buckets(spark, d):
    """The way of long orders, whatever the size."""
    got = ser.fill_missing(gapped(spark, d), ["v"], "row_id", rows_per_bucket=500)
    return got.select("row_id", r("v").alias("v"))


@query("E1_fill_both_ways_by_key", fill_sql("produto"))
def fill_by_key(spark, d):
    return ser.fill_missing(gapped(spark, d), ["v"], "row_id", ["produto"]).select("row_id", r("v").alias("v"))


def change_sql(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"(SELECT *, venda / NULLIF(lag(venda) OVER ({part} ORDER BY row_id), 0) - 1 AS change FROM {t.PRICES_SQL})"


@query("E2_percent_change", f"SELECT row_id, round(change, 6) AS change FROM {change_sql('produto')}")
def percent_change(spark, d):
    return ser.percent_change(t.prices(spark, d), "venda", "row_id", ["produto"]).select("row_id", r("change").alias("change"))


@query("E2_percent_change_small_buckets", f"SELECT row_id, round(change, 6) AS change FROM {change_sql('produto')}")
def percent_change_small_buckets(spark, d):
    got = ser.percent_change(t.prices(spark, d), "venda", "row_id", ["produto"], rows_per_bucket=500)
    return got.select("row_id", r("change").alias("change"))


@query("E2_percent_change_file_order", f"SELECT row_id, round(change, 6) AS change FROM {change_sql('')}")
def percent_change_file(spark, d):
    return ser.percent_change(t.prices(spark, d), "venda", "row_id").select("row_id", r("change").alias("change"))


VOLATILITY_SQL = "(SELECT produto, last_day(data) AS month_end, stddev_samp(change) AS volatility FROM {source} GROUP BY 1, 2)"
FILE_VOLATILITY_SQL = VOLATILITY_SQL.format(source=change_sql(""))


@query(
    "E3_monthly_volatility",
    f"SELECT produto, CAST(month_end AS VARCHAR) AS month_end, round(volatility, 5) AS volatility FROM {FILE_VOLATILITY_SQL}",
)
def monthly_volatility(spark, d):
    got = ser.monthly_volatility(t.prices(spark, d), "data", "venda", "produto", "row_id", scope="file")
    return got.select("produto", day("month_end"), r("volatility", 5).alias("volatility"))


@query(
    "C2_volatility_join",
    f"""SELECT produto, CAST(p.month_end AS VARCHAR) AS month_end, round(venda, 6) AS venda, round(volatility, 5) AS volatility
    FROM {PANEL_SQL} p LEFT JOIN {VOLATILITY_SQL.format(source=change_sql('produto'))} USING (produto, month_end)""",
)
def volatility_join(spark, d):
    rows = t.prices(spark, d)
    panel = ser.monthly_mean(rows, "data", ["venda"], ["produto"])
    vol = ser.monthly_volatility(rows, "data", "venda", "produto", "row_id")
    got = panel.join(vol, ["produto", "month_end"], "left")
    return got.select("produto", day("month_end"), r("venda").alias("venda"), r("volatility", 5).alias("volatility"))


@query("E4_shift_one", f"SELECT row_id, round(lag(venda) OVER (ORDER BY row_id), 6) AS prev FROM {t.PRICES_SQL}")
def shift_one(spark, d):
    from terralag.operators.ordered import previous_row

    return previous_row(t.prices(spark, d), ["venda"], "row_id").select("row_id", r("prev_venda").alias("prev"))


@query(
    "E5_lag_table",
    f"""SELECT produto, CAST(month_end AS VARCHAR) AS month_end, round(target, 6) AS target, round(lag_1, 6) AS lag_1,
    round(lag_2, 6) AS lag_2, round(lag_3, 6) AS lag_3 FROM (SELECT produto, month_end, venda AS target, lag(venda, 1) OVER w AS lag_1,
    lag(venda, 2) OVER w AS lag_2, lag(venda, 3) OVER w AS lag_3 FROM {PANEL_SQL} WINDOW w AS (PARTITION BY produto ORDER BY month_end))
    WHERE lag_3 IS NOT NULL""",
)
def lag_table(spark, d):
    panel = ser.monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    got = ser.lag_table(panel, "produto", "month_end", "venda")
    return got.select("produto", day("month_end"), *[r(c).alias(c) for c in ("target", "lag_1", "lag_2", "lag_3")])


@query(
    "E6_first_difference",
    f"""SELECT produto, CAST(month_end AS VARCHAR) AS month_end, round(diff, 6) AS diff FROM (SELECT produto, month_end,
    venda - lag(venda) OVER (PARTITION BY produto ORDER BY month_end) AS diff FROM {PANEL_SQL}) WHERE diff IS NOT NULL""",
)
def first_difference(spark, d):
    panel = ser.monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    return ser.difference(panel, "produto", "month_end", "venda").select("produto", day("month_end"), r("diff").alias("diff"))


THIN_SQL = f"(SELECT * FROM {t.PRICES_SQL} WHERE month(data) % 4 <> 1)"


@query(
    "E7_month_end_series",
    f"""SELECT produto, CAST(month_end AS VARCHAR) AS month_end, round(venda, 6) AS venda
    FROM (SELECT produto, last_day(CAST(unnest(generate_series(date_trunc('month', min(data)), date_trunc('month', max(data)), INTERVAL 1 MONTH)) AS DATE)) AS month_end
    FROM {THIN_SQL} GROUP BY produto)
    LEFT JOIN (SELECT produto, last_day(data) AS month_end, avg(venda) AS venda FROM {THIN_SQL} GROUP BY 1, 2) USING (produto, month_end)""",
)
def month_end_series(spark, d):
    """Some months are taken out, so the gaps have to be put back as NULL rows."""
    thin = t.prices(spark, d).filter(F.month("data") % 4 != 1)
    got = ser.month_end_series(thin, "data", ["venda"], ["produto"])
    return got.select("produto", day("month_end"), r("venda").alias("venda"))


@query(
    "E8_next_month_start",
    f"SELECT CAST(month AS VARCHAR) AS month, round(dol_val, 6) AS dol_val FROM {FX_SQL}",
)
def next_month_start(spark, d):
    return fx_monthly(spark, d).select(day("month"), r("dol_val").alias("dol_val"))


def decompose_sql(source: str, keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    phase = f"PARTITION BY {keys + ', ' if keys else ''}pos % 12"
    select = f"{keys}, " if keys else ""
    return f"""WITH a AS (SELECT *, row_number() OVER ({part} ORDER BY month_end) - 1 AS pos FROM {source}),
    b AS (SELECT *, CASE WHEN count(*) OVER w = 13 THEN (sum(venda) OVER w - (lag(venda, 6) OVER o + lead(venda, 6) OVER o) / 2) / 12 END AS trend
      FROM a WINDOW w AS ({part} ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), o AS ({part} ORDER BY pos)),
    c AS (SELECT *, avg(venda - trend) OVER ({phase}) AS pm FROM b),
    e AS (SELECT *, pm - avg(CASE WHEN pos < 12 THEN pm END) OVER ({part}) AS seasonal FROM c)
    SELECT {select}CAST(month_end AS VARCHAR) AS month_end, pos AS position, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal,
    round(venda - trend - seasonal, 6) AS resid FROM e"""


def _decomposed(df, *keys):
    return df.select(*keys, day("month_end"), "position", r("trend").alias("trend"), r("seasonal").alias("seasonal"), r("resid").alias("resid"))


@query("E9_decomposition_by_product", decompose_sql(PANEL_SQL, "produto"))
def decomposition(spark, d):
    panel = ser.monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    return _decomposed(ser.decompose(panel, "month_end", "venda", ["produto"]), "produto")


@query(
    "E9_decomposition_overall",
    decompose_sql(f"(SELECT last_day(data) AS month_end, avg(venda) AS venda FROM {t.PRICES_SQL} GROUP BY 1)", ""),
)
def decomposition_overall(spark, d):
    series = ser.monthly_mean(t.prices(spark, d), "data", ["venda"]).withColumn("all", F.lit(0))
    return _decomposed(ser.decompose(series, "month_end", "venda", ["all"]))


@query(
    "E10_dickey_fuller_lag0",
    f"""SELECT produto, round(slope / sqrt((syy - slope * sxy) / (n - 2) / sxx), 5) AS statistic FROM (
    SELECT produto, regr_slope(dy, prev) AS slope, regr_syy(dy, prev) AS syy, regr_sxy(dy, prev) AS sxy, regr_sxx(dy, prev) AS sxx,
    regr_count(dy, prev) AS n FROM (SELECT produto, lag(venda) OVER w AS prev, venda - lag(venda) OVER w AS dy
    FROM {PANEL_SQL} WINDOW w AS (PARTITION BY produto ORDER BY month_end)) GROUP BY produto)""",
)
def dickey_fuller_lag0(spark, d):
    from terralag.operators.stationarity import dickey_fuller_lag0 as lag0

    panel = ser.monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    return lag0(panel, "produto", "month_end", "venda").select("produto", r("statistic", 5).alias("statistic"))


@query("E10_unit_root_test")
def unit_root(spark, d):
    from terralag.operators.stationarity import unit_root_tests

    panel = ser.monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    return unit_root_tests(panel, "produto", "month_end", "venda").withColumns(
        {"statistic": r("statistic"), "p_value": r("p_value")}
    )


@query(
    "E11_expanding_folds",
    f"""WITH a AS (SELECT produto, month_end, row_number() OVER (PARTITION BY produto ORDER BY month_end) - 1 AS pos,
      count(*) OVER (PARTITION BY produto) AS n FROM {PANEL_SQL}),
    b AS (SELECT *, n // 6 AS size, unnest(range(0, 5)) AS fold FROM a),
    c AS (SELECT *, CASE WHEN pos < n - (5 - fold) * size THEN 'train' WHEN pos < n - (4 - fold) * size THEN 'val' END AS part FROM b)
    SELECT produto, fold, part, count(*) AS n, CAST(min(month_end) AS VARCHAR) AS first, CAST(max(month_end) AS VARCHAR) AS last
    FROM c WHERE part IS NOT NULL GROUP BY 1, 2, 3""",
)
def expanding_folds(spark, d):
    panel = ser.monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    folds = ser.expanding_folds(panel, "produto", "month_end")
    return folds.groupBy("produto", "fold", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("month_end").cast("string").alias("first"),
        F.max("month_end").cast("string").alias("last"),
    )


@query(
    "E12_last_rows",
    f"""SELECT produto, CAST(month_end AS VARCHAR) AS month_end, round(venda, 6) AS venda FROM {PANEL_SQL}
    QUALIFY row_number() OVER (PARTITION BY produto ORDER BY month_end DESC) <= 3""",
)
def last_rows(spark, d):
    panel = ser.monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    return ser.last_rows(panel, "produto", "month_end", 3).select("produto", day("month_end"), r("venda").alias("venda"))


@query(
    "M10_naive_forecasts",
    f"""SELECT produto, CAST(month_end AS VARCHAR) AS month_end, round(lag(venda, 12) OVER w, 6) AS seasonal_naive,
    round(lag(venda, 1) OVER w, 6) AS last_value FROM {PANEL_SQL} WINDOW w AS (PARTITION BY produto ORDER BY month_end)""",
)
def naive_forecasts(spark, d):
    panel = ser.monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    got = ser.naive_forecasts(panel, "produto", "month_end", "venda")
    return got.select("produto", day("month_end"), r("seasonal_naive").alias("seasonal_naive"), r("last_value").alias("last_value"))


@query(
    "M9_forecast_summary",
    f"""SELECT produto, round(sqrt(avg((venda - p) * (venda - p))), 6) AS rmse, round(avg(abs(venda - p)), 6) AS mae,
    round(100 * avg(abs((venda - p) / NULLIF(venda, 0))), 5) AS mape_percent
    FROM (SELECT produto, venda, lag(venda, 12) OVER (PARTITION BY produto ORDER BY month_end) AS p FROM {PANEL_SQL}) GROUP BY produto""",
)
def forecast_summary(spark, d):
    from terralag.operators.forecasting import summarise

    panel = ser.monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    got = ser.naive_forecasts(panel, "produto", "month_end", "venda").withColumnRenamed("venda", "actual")
    out = summarise(got, "produto", "seasonal_naive")
    return out.select("produto", r("rmse").alias("rmse"), r("mae").alias("mae"), r("mape_percent", 5).alias("mape_percent"))
