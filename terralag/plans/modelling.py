"""Regression, selection, tuning, scoring and forecasting queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from terralag.operators import forecasting as fc
from terralag.operators import selection as sel
from terralag.operators import series as ser
from terralag.operators import tuning as tune
from terralag.operators.folds import k_folds, train_test_split
from terralag.operators.models import make_pipeline
from terralag.operators.outliers import remove_outliers_iqr
from terralag.operators.scoring import point_features, submission
from terralag.plans import tables as t
from terralag.plans.ingest import r
from terralag.plans.registry import query
from terralag.plans.stats import panel_fx
from terralag.session import spread

LABEL = "uhi"
METRICS = ("r2", "rmse", "mape_percent")


def folded(spark, d, k=3):
    return k_folds(t.model_table(spark, d), "pixel_id", k)


def _fit_report(name: str, model: str, scaler=None, **params):
    """Fit on the training part, report the test metrics of the model and of the training mean.

    Forests and boosters have the usual 100 trees, bags their 10 members.
    """

    def run(spark, d):
        split = train_test_split(t.model_table(spark, d), "pixel_id", 0.25)
        train, test = spread(split.filter("part = 'train'")).persist(StorageLevel.MEMORY_AND_DISK), split.filter("part = 'test'")
        rows = []
        for label, kind, extra in ((model, model, params), ("mean", "mean", {})):
            fitted = make_pipeline(kind, t.MODEL_FEATURES, LABEL, scaler if kind != "mean" else None, **extra).fit(train)
            got = tune.score(fitted.transform(test), LABEL, METRICS)
            rows.append((label, *[got[m] for m in METRICS]))
        train.unpersist()
        return spark.createDataFrame(rows, "model string, r2 double, rmse double, mape_percent double")

    query(name)(run)


_fit_report("K1_extra_trees", "extra_trees", n_estimators=100, max_depth=10)
_fit_report("K2_random_forest", "random_forest", n_estimators=100, max_depth=10, min_samples_split=4, max_features="sqrt")
_fit_report("K3_bagging", "bagging", n_estimators=10, max_samples=0.8, max_features=0.8)
_fit_report("K4_hist_gradient_boosting", "hist_gradient_boosting", max_iter=100, max_depth=5, learning_rate=0.1)
_fit_report("K5_lightgbm", "lightgbm", n_estimators=100, num_leaves=31, learning_rate=0.1)
_fit_report(
    "K6_xgboost", "xgboost", n_estimators=100, max_depth=5, learning_rate=0.1, subsample=0.8, colsample_bytree=0.8, min_child_weight=2
)


@query("K7_bayesian_ridge")
def bayesian_ridge(spark, d):
    """Coefficients from one aggregation of second moments."""
    from terralag.operators.impute import _moment_aggs, _moment_matrix, bayesian_ridge as solve

    rows = t.model_table(spark, d)
    names = [*t.MODEL_FEATURES, LABEL]
    moments = rows.agg(*_moment_aggs([F.col(c).cast("double") for c in names])).first()
    intercept, coef = solve(_moment_matrix(moments, len(names) + 1), len(names))
    values = [("intercept", float(intercept)), *zip(t.MODEL_FEATURES, map(float, coef))]
    return spark.createDataFrame(values, "term string, weight double")


@query("K8_model_zoo")
def model_zoo(spark, d):
    return tune.model_zoo_report(folded(spark, d), t.MODEL_FEATURES, LABEL, folds=3, parallelism=4)


@query(
    "K8_linear_cross_validation",
    f"""WITH m AS (SELECT pixel_id, CAST(B08 AS DOUBLE) AS x, {t.MODEL_COLUMNS['uhi']} AS y,
      ('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|42'), 1, 8))::BIGINT % 3 AS fold
      FROM (SELECT *, c_custkey AS pixel_id, {t.PIXEL_COLUMNS['B08']} AS B08 FROM customer)),
    c AS (SELECT f AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM m, range(0, 3) r(f) WHERE m.fold <> f GROUP BY f)
    SELECT fold, round(1 - avg((y - a - b * x) * (y - a - b * x)) / var_pop(y), 6) AS r2, round(avg(abs((y - a - b * x) / y)), 6) AS mape_fraction
    FROM m JOIN c USING (fold) GROUP BY fold""",
)
def linear_cv(spark, d):
    got = tune.cross_validate(folded(spark, d), lambda: make_pipeline("linear", ["B08"], LABEL, solver="normal"), LABEL, 3)
    return got.select(F.col("fold").cast("bigint").alias("fold"), r("r2").alias("r2"), r("mape_fraction").alias("mape_fraction"))


@query(
    "K8_ridge_one_feature",
    f"""SELECT round(b, 8) AS coefficient, round(my - b * mx, 6) AS intercept FROM (
    SELECT regr_sxy(y, x) / (regr_sxx(y, x) + 1e6) AS b, avg(x) AS mx, avg(y) AS my FROM (
    SELECT CAST({t.PIXEL_COLUMNS['B08']} AS DOUBLE) AS x, {t.MODEL_COLUMNS['uhi']} AS y FROM customer))""",
)
def ridge_one_feature(spark, d):
    fitted = make_pipeline("ridge", ["B08"], LABEL, alpha=1e6).fit(t.model_table(spark, d)).stages[-1]
    row = [(float(fitted.coefficients[0]), float(fitted.intercept))]
    got = spark.createDataFrame(row, "coefficient double, intercept double")
    return got.select(r("coefficient", 8).alias("coefficient"), r("intercept").alias("intercept"))


@query("J8_select_from_model")
def select_from_model(spark, d):
    table = sel.importance_table(t.model_table(spark, d), t.MODEL_FEATURES, LABEL, n_estimators=100, max_depth=8)
    return sel.select_from_model(table, 0.98)


@query("J9_importance_ranking")
def importance_ranking(spark, d):
    return sel.importance_table(t.model_table(spark, d), t.MODEL_FEATURES, LABEL, n_estimators=100, max_depth=8)


def _ranked(spark, d):
    table = sel.importance_table(t.model_table(spark, d), t.MODEL_FEATURES, LABEL, n_estimators=10, max_depth=6)
    return [row["feature"] for row in table.collect()]


@query("J10_forward_selection")
def forward_selection(spark, d):
    return sel.forward_selection(
        folded(spark, d), _ranked(spark, d), LABEL, folds=3, parallelism=3, n_estimators=10, max_depth=6
    )


GRID = [
    *tune.grid("random_forest", (None, "standard", "minmax"), n_estimators=[5, 10], max_depth=[4, 8]),
    *tune.grid("lightgbm", (None,), n_estimators=[10], num_leaves=[15, 31]),
]


@query("L1_scaler_step_grid")
def scaler_grid(spark, d):
    configs = tune.grid("linear", (None, "standard", "minmax", "robust"))
    return tune.search(folded(spark, d), configs, t.MODEL_FEATURES, LABEL, 3, parallelism=4)


@query("L2_grid_search")
def grid_search(spark, d):
    return tune.search(folded(spark, d), GRID, t.MODEL_FEATURES, LABEL, 3, parallelism=4)


@query("L3_failing_configurations")
def failing_configurations(spark, d):
    configs = [*tune.grid("ridge", alpha=[0.1]), *tune.grid("random_forest", n_estimators=[0])]
    return tune.search(folded(spark, d), configs, t.MODEL_FEATURES, LABEL, 3)


@query("L4_randomised_search")
def randomised_search(spark, d):
    space = {
        "n_estimators": ("int", 5, 15),
        "max_depth": ("int", 2, 6),
        "subsample": ("uniform", 0.6, 0.1),
        "learning_rate": ("uniform", 0.05, 0.2),
    }
    return tune.search(folded(spark, d), tune.random_draws("xgboost", 4, space), t.MODEL_FEATURES, LABEL, 3, parallelism=4)


MODEL_SQL = f"""(SELECT {t.MODEL_COLUMNS['uhi']} AS y, ('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|42'), 1, 8))::BIGINT % 5 AS fold FROM customer)"""


@query(
    "L5_cross_validate_mean",
    f"""WITH m AS {MODEL_SQL}, p AS (SELECT f AS fold, avg(y) AS p FROM m, range(0, 5) r(f) WHERE m.fold <> f GROUP BY f),
    s AS (SELECT fold, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2, avg(abs((y - p) / y)) AS mape FROM m JOIN p USING (fold) GROUP BY fold)
    SELECT round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std, round(avg(mape), 6) AS mape_mean, round(stddev_pop(mape), 6) AS mape_std FROM s""",
)
def cross_validate_mean(spark, d):
    report = tune.cross_validate(folded(spark, d, 5), lambda: make_pipeline("mean", t.MODEL_FEATURES, LABEL), LABEL, 5)
    from terralag.functions.metrics import fold_summary

    got = fold_summary(report.withColumnRenamed("mape_fraction", "mape"), ["r2", "mape"])
    return got.select(*[r(c).alias(c) for c in ("r2_mean", "r2_std", "mape_mean", "mape_std")])


FOLD3_SQL = f"""(SELECT c_custkey AS pixel_id, CAST({t.PIXEL_COLUMNS['B08']} AS DOUBLE) AS x, {t.MODEL_COLUMNS['uhi']} AS y,
    ('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|42'), 1, 8))::BIGINT % 3 AS fold FROM customer)"""
LINEAR_SQL = f"""m AS {FOLD3_SQL},
    c AS (SELECT f AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS mean FROM m, range(0, 3) r(f) WHERE m.fold <> f GROUP BY f),
    s AS (SELECT fold, 1 - avg((y - a - b * x) * (y - a - b * x)) / var_pop(y) AS r2, avg(abs((y - a - b * x) / y)) AS mape,
      1 - avg((y - mean) * (y - mean)) / var_pop(y) AS r2_mean_model, avg(abs((y - mean) / y)) AS mape_mean_model FROM m JOIN c USING (fold) GROUP BY fold)"""


def _short(report):
    return report.select(F.col("experiment").cast("bigint").alias("experiment"), "scaler", r("r2_mean").alias("r2_mean"), r("mape_mean").alias("mape_mean"), "failed")


@query(
    "L1_scaler_step_grid_linear",
    f"""WITH {LINEAR_SQL} SELECT e.experiment, e.scaler, round(avg(r2), 6) AS r2_mean, round(avg(mape), 6) AS mape_mean, false AS failed
    FROM s, (VALUES (1, NULL), (2, 'standard'), (3, 'minmax'), (4, 'robust')) e(experiment, scaler) GROUP BY 1, 2""",
)
def scaler_grid_linear(spark, d):
    """A linear fit does not depend on the scaler: all four rows are the closed form."""
    configs = tune.grid("linear", (None, "standard", "minmax", "robust"), solver=["normal"])
    return _short(tune.search(folded(spark, d), configs, ["B08"], LABEL, 3, parallelism=4))


@query(
    "L2_mape_scorer",
    f"""WITH {LINEAR_SQL} SELECT 'mean' AS model, round(avg(mape_mean_model), 6) AS scorer FROM s
    UNION ALL SELECT 'linear', round(avg(mape), 6) FROM s""",
)
def mape_scorer(spark, d):
    configs = [*tune.grid("mean"), *tune.grid("linear", solver=["normal"])]
    got = tune.search(folded(spark, d), configs, ["B08"], LABEL, 3, scorer=tune.MapeEvaluator(LABEL))
    return got.select("model", r("scorer").alias("scorer"))


@query(
    "L3_failing_configurations_linear",
    f"""WITH {LINEAR_SQL} SELECT 1 AS experiment, round(avg(r2), 6) AS r2_mean, false AS failed FROM s
    UNION ALL SELECT 2, CAST('-Infinity' AS DOUBLE), true""",
)
def failing_linear(spark, d):
    configs = [*tune.grid("linear", solver=["normal"]), *tune.grid("random_forest", n_estimators=[0])]
    got = _short(tune.search(folded(spark, d), configs, ["B08"], LABEL, 3))
    return got.select("experiment", "r2_mean", "failed")


@query(
    "L7_candidate_comparison_linear",
    f"""WITH {LINEAR_SQL} SELECT model, round(r2_mean, 6) AS r2_mean, round(r2_std, 6) AS r2_std FROM (
    SELECT 'mean' AS model, avg(r2_mean_model) AS r2_mean, stddev_pop(r2_mean_model) AS r2_std FROM s
    UNION ALL SELECT 'linear', avg(r2), stddev_pop(r2) FROM s)""",
)
def candidate_comparison_linear(spark, d):
    configs = [*tune.grid("mean"), *tune.grid("linear", ("robust",), solver=["normal"])]
    got = tune.search(folded(spark, d), configs, ["B08"], LABEL, 3)
    return got.select("model", r("r2_mean").alias("r2_mean"), r("r2_std").alias("r2_std"))


@query("L6_subset_search")
def subset_search(spark, d):
    """The three best feature prefixes, each with two boosted models; best configuration first."""
    data = folded(spark, d)
    forward = sel.forward_selection(data, _ranked(spark, d), LABEL, folds=3, parallelism=3, model="linear")
    subsets = [row["features"] for row in sel.smallest(forward, "mape_mean", 3, "num_features").collect()]
    configs = [
        {**c, "features": subset}
        for subset in subsets
        for c in (
            *tune.grid("lightgbm", ("standard",), n_estimators=[10], num_leaves=[15]),
            *tune.grid("xgboost", ("standard",), n_estimators=[10], max_depth=[3]),
        )
    ]
    return tune.search(data, configs, t.MODEL_FEATURES, LABEL, 3, parallelism=4).orderBy("mape_mean", "experiment")


# the ten candidate settings compared against overfitting: fixed values 
CANDIDATES = [
    {"learning_rate": 0.05, "max_depth": 10, "n_estimators": 300, "subsample": 0.8},
    {"learning_rate": 0.1, "max_depth": 10, "n_estimators": 600, "subsample": 0.8, "reg_lambda": 1},
    {"learning_rate": 0.1, "max_depth": 10, "n_estimators": 600, "subsample": 0.8, "reg_alpha": 0.1},
    {"learning_rate": 0.1, "max_depth": 8, "n_estimators": 300, "subsample": 0.8},
    {"learning_rate": 0.1, "max_depth": 10, "n_estimators": 300, "subsample": 0.8, "colsample_bytree": 0.8},
    {"learning_rate": 0.1, "max_depth": 10, "n_estimators": 600, "subsample": 0.7},
    {"learning_rate": 0.05, "max_depth": 10, "n_estimators": 400, "subsample": 0.8},
    {"learning_rate": 0.05, "max_depth": 8, "n_estimators": 300, "subsample": 0.8, "reg_lambda": 1, "reg_alpha": 0.1},
    {"learning_rate": 0.1, "max_depth": 8, "n_estimators": 300, "subsample": 0.7, "colsample_bytree": 0.8},
    {"learning_rate": 0.05, "max_depth": 8, "n_estimators": 200, "subsample": 0.7, "reg_lambda": 1, "colsample_bytree": 0.8},
]


def candidates() -> list[dict]:
    """The ten settings at their own depth and with all their trees."""
    return [{"model": "xgboost", "scaler": "robust", "packed": True, "params": dict(c)} for c in CANDIDATES]


@query("L7_candidate_comparison")
def candidate_comparison(spark, d):
    """The ten candidates as they are: 3,900 trees in each of 3 folds."""
    return tune.search(folded(spark, d), candidates(), t.MODEL_FEATURES, LABEL, 3, parallelism=4).orderBy("mape_mean", "experiment")


@query(
    "L8_refit_best",
    f"""WITH m AS (SELECT c_custkey AS pixel_id, CAST({t.PIXEL_COLUMNS['B08']} AS DOUBLE) AS x, {t.MODEL_COLUMNS['uhi']} AS y FROM customer)
    SELECT pixel_id, round((SELECT regr_intercept(y, x) FROM m) + (SELECT regr_slope(y, x) FROM m) * x, 6) AS prediction FROM m""",
)
def refit_best(spark, d):
    """Search mean against linear, refit the winner on all rows."""
    data = folded(spark, d)
    configs = [*tune.grid("mean"), *tune.grid("linear", solver=["normal"])]
    report = tune.search(data, configs, ["B08"], LABEL, 3)
    fitted = tune.refit(data, tune.best_config(report, configs, "r2_mean"), ["B08"], LABEL)
    return fitted.transform(data).select("pixel_id", r("prediction").alias("prediction"))


@query("L9_batch_scoring")
def batch_scoring(spark, d):
    """Fit on the pixels, score the points: nearest pixel, indices, prediction, submission columns."""
    train = remove_outliers_iqr(t.model_table(spark, d), 5.0, [LABEL])
    fitted = make_pipeline("xgboost", t.MODEL_FEATURES, LABEL, "standard", n_estimators=10, max_depth=4).fit(train)
    rows = point_features(
        t.points(spark, d), t.pixels(spark, d), "point_id", "pixel_id", ("px", "py"), ("x", "y"), ["NDVI", "NDBI"]
    )
    return submission(fitted.transform(rows), "px", "py")


@query(
    "L9_scoring_with_gaps",
    f"""WITH m AS (SELECT c_custkey AS pixel_id, CASE WHEN c_custkey % 5 <> 0 THEN CAST({t.PIXEL_COLUMNS['B08']} AS DOUBLE) END AS x,
      {t.MODEL_COLUMNS['uhi']} AS y FROM customer),
    f AS (SELECT pixel_id, y, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM m)) AS x FROM m),
    c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f)
    SELECT pixel_id, round(a + b * x, 6) AS prediction FROM f, c""",
)
def scoring_with_gaps(spark, d):
    """Every fifth pixel lacks the band: it is filled with the training median and scored like the others."""
    rows = t.model_table(spark, d).withColumn("B08", F.when(F.col("pixel_id") % 5 != 0, F.col("B08")))
    fitted = make_pipeline("linear", ["B08"], LABEL, solver="normal").fit(rows)
    return fitted.transform(rows).select("pixel_id", r("prediction").alias("prediction"))


@query("J8_pipeline_selection_steps")
def pipeline_selection_steps(spark, d):
    """Variance threshold, k best, select-from-model and quantile scaling as swappable steps."""
    configs = [
        {"model": "linear", "scaler": scaler, "select": select, "params": {}}
        for scaler, select in (("quantile", None), ("standard", ("variance", 0.001)), ("minmax", ("k_best", 3)), ("robust", ("importance", 0.98)))
    ]
    return tune.search(folded(spark, d), configs, t.MODEL_FEATURES, LABEL, 3, parallelism=4)


@query("J8_polynomial_selection_scores")
def polynomial_scores(spark, d):
    """Degree-3 features, linear model: cross-validated scores."""
    configs = [{"model": "linear", "scaler": "standard", "params": {"degree": n}} for n in (1, 2, 3)]
    return tune.search(folded(spark, d), configs, t.MODEL_FEATURES, LABEL, 3, parallelism=3)


# ---- forecasting


TEST_MONTHS = 12


def panel(spark, d):
    return ser.fill_panel(panel_fx(spark, d), "produto", "month_end", "dol_val")


def training(spark, d):
    """All but the last months of each series."""
    rows = panel(spark, d)
    test = ser.last_rows(rows, "produto", "month_end", TEST_MONTHS).select("produto", "month_end")
    return rows.join(test, ["produto", "month_end"], "left_anti")


def chosen(spark, d, exog=None):
    return fc.search_orders(training(spark, d), "produto", "month_end", "venda", fc.order_grid(), exog)


@query("M1_order_search")
def order_search(spark, d):
    """The whole 729-order grid for every series."""
    return fc.search_orders(training(spark, d), "produto", "month_end", "venda", fc.order_grid())


@query("M1_order_search_restricted")
def order_search_restricted(spark, d):
    return fc.search_orders(training(spark, d), "produto", "month_end", "venda", fc.order_grid(p=(0,), sp=(0,)))


AR1_SQL = """SELECT produto, round(n * ln((syy - 2 * b * sxy + b * b * sxx) / n) + 4, 5) AS aic, round(b, 6) AS coefficient FROM (
    SELECT produto, sum(y * x) / sum(x * x) AS b, sum(y * y) AS syy, sum(y * x) AS sxy, sum(x * x) AS sxx, count(*) AS n FROM (
    SELECT produto, venda AS y, lag(venda) OVER (PARTITION BY produto ORDER BY month_end) AS x FROM {}) WHERE x IS NOT NULL GROUP BY produto)"""


@query(
    "M1_autoregression_aic",
    "SELECT produto, aic FROM ("
    + AR1_SQL.format(
        "(SELECT produto, last_day(data) AS month_end, avg(venda) AS venda FROM " + t.PRICES_SQL + " GROUP BY 1, 2)"
    )
    + ")",
)
def autoregression_aic(spark, d):
    fits = fc.fit_orders(panel(spark, d), "produto", "month_end", "venda", [(1, 0, 0, 0, 0, 0)])
    return fits.select("produto", r("aic", 5).alias("aic"))


SERIES_SQL = f"""(SELECT *, lag(y) OVER w AS l1, lag(y, 2) OVER w AS l2, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY produto) AS n
    FROM (SELECT produto, last_day(data) AS month_end, avg(venda) AS y FROM {t.PRICES_SQL} GROUP BY 1, 2) WINDOW w AS (PARTITION BY produto ORDER BY month_end))"""


@query(
    "M1_order_comparison",
    f"""WITH s AS {SERIES_SQL},
    c AS (SELECT produto, sum(y * l1) / sum(l1 * l1) AS b,
      sum(y * l1) FILTER (i > 1) AS y1, sum(y * l2) FILTER (i > 1) AS y2, sum(l1 * l1) FILTER (i > 1) AS a11,
      sum(l1 * l2) FILTER (i > 1) AS a12, sum(l2 * l2) FILTER (i > 1) AS a22, count(*) FILTER (i > 1) AS m FROM s GROUP BY produto),
    k AS (SELECT *, (y1 * a22 - y2 * a12) / (a11 * a22 - a12 * a12) AS b1, (a11 * y2 - a12 * y1) / (a11 * a22 - a12 * a12) AS b2 FROM c),
    e AS (SELECT produto, m, sum((y - b * l1) * (y - b * l1)) AS one, sum((y - b1 * l1 - b2 * l2) * (y - b1 * l1 - b2 * l2)) AS two,
      sum((y - l1) * (y - l1)) AS walk FROM s JOIN k USING (produto) WHERE i > 1 GROUP BY produto, m)
    SELECT produto, 1 AS p, 0 AS d, round(m * ln(one / m) + 4, 4) AS aic FROM e UNION ALL
    SELECT produto, 2, 0, round(m * ln(two / m) + 6, 4) FROM e UNION ALL SELECT produto, 0, 1, round(m * ln(walk / m) + 2, 4) FROM e""",
)
def order_comparison(spark, d):
    """Two autoregressions and a random walk, judged on the same months."""
    orders = [(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0)]
    fits = fc.fit_orders(panel(spark, d), "produto", "month_end", "venda", orders)
    return fits.select("produto", F.col("p").cast("bigint").alias("p"), F.col("d").cast("bigint").alias("d"), r("aic", 4).alias("aic"))


@query("M2_fallback_order", "SELECT DISTINCT o_orderpriority AS produto, 1 AS p, 1 AS d, 1 AS q, 0 AS sp, 1 AS sd, 1 AS sq FROM orders")
def fallback_order(spark, d):
    """Series cut to six months cannot carry any seasonal order."""
    short = ser.last_rows(panel(spark, d), "produto", "month_end", 6)
    got = fc.search_orders(short, "produto", "month_end", "venda", [(2, 2, 2, 2, 2, 2)])
    return got.select("produto", *[F.col(f).cast("bigint").alias(f) for f in fc.ORDER_FIELDS])


@query("M3_regressor_variants")
def regressor_variants(spark, d):
    """Best AIC over the restricted grid without a regressor, with the exchange rate, with last month's
    purchase price, with last month's volatility for one series only."""
    from pyspark.sql import Window

    w = Window.partitionBy("produto").orderBy("month_end")
    rows = training(spark, d).withColumn("compra_lag", F.lag("compra").over(w))
    vol = ser.monthly_volatility(t.prices(spark, d), "data", "venda", "produto", "row_id")
    rows = ser.fill_panel(rows.join(vol, ["produto", "month_end"], "left"), "produto", "month_end", "volatility")
    rows = rows.withColumn("volatility", F.lag("volatility").over(w))
    variants = (("none", None, None), ("rate", "dol_val", None), ("purchase", "compra_lag", None), ("volatility", "volatility", ["2-HIGH"]))
    parts = None
    for name, exog, keys in variants:
        best = fc.search_orders(rows, "produto", "month_end", "venda", fc.order_grid(p=(0,), sp=(0,)), exog, keys)
        part = best.withColumn("variant", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("M4_rolling_forecast")
def rolling_forecast(spark, d):
    return fc.rolling_forecasts(panel(spark, d), chosen(spark, d), "produto", "month_end", "venda", TEST_MONTHS)


def first_order(spark, d):
    """The order (1, 0, 0) for every series."""
    fixed = dict(zip(fc.ORDER_FIELDS, (1, 0, 0, 0, 0, 0)))
    return panel(spark, d).select("produto").distinct().withColumns({f: F.lit(v) for f, v in fixed.items()})


#: The coefficient from the months before each month.
SLOPE_SQL = f"""(SELECT *, sum(y * l1) OVER before / sum(l1 * l1) OVER before AS b FROM {SERIES_SQL}
    WINDOW before AS (PARTITION BY produto ORDER BY month_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _forecast_rows(got):
    return got.select("produto", "month_end", r("actual", 5).alias("actual"), r("predicted", 5).alias("predicted"))


@query(
    "M4_rolling_forecast_first_order",
    f"SELECT produto, month_end, round(y, 5) AS actual, round(b * l1, 5) AS predicted FROM {SLOPE_SQL} WHERE i >= n - {TEST_MONTHS}",
)
def rolling_first_order(spark, d):
    return _forecast_rows(fc.rolling_forecasts(panel(spark, d), first_order(spark, d), "produto", "month_end", "venda", TEST_MONTHS))


@query(
    "M5_recursive_forecast_first_order",
    f"""WITH s AS {SLOPE_SQL} SELECT s.produto, s.month_end, round(s.y, 5) AS actual, round(pow(o.b, s.i - o.i + 1) * o.l1, 5) AS predicted
    FROM s JOIN s o ON s.produto = o.produto AND o.i = s.n - 3 AND s.i >= o.i""",
)
def recursive_first_order(spark, d):
    return _forecast_rows(fc.rolling_forecasts(panel(spark, d), first_order(spark, d), "produto", "month_end", "venda", 3, horizon=3))


@query(
    "M7_time_series_cv_first_order",
    f"""WITH s AS (SELECT *, b * l1 AS f, i - (n - 5 * (n // 6)) AS spot FROM {SLOPE_SQL})
    SELECT produto, spot // (n // 6) AS fold, round(sqrt(avg((y - f) * (y - f))), 5) AS rmse, round(avg(abs(y - f)), 5) AS mae FROM s WHERE spot >= 0 GROUP BY 1, 2""",
)
def cv_first_order(spark, d):
    got = fc.rolling_cv(panel(spark, d), first_order(spark, d), "produto", "month_end", "venda")
    return got.select("produto", "fold", r("rmse", 5).alias("rmse"), r("mae", 5).alias("mae"))


@query(
    "M8_residuals_first_order",
    f"""WITH s AS {SERIES_SQL} SELECT produto, month_end, round(y - c.b * l1, 5) AS residual
    FROM s JOIN (SELECT produto, sum(y * l1) / sum(l1 * l1) AS b FROM s GROUP BY 1) c USING (produto) WHERE l1 IS NOT NULL""",
)
def residuals_first_order(spark, d):
    got = fc.residual_table(panel(spark, d), first_order(spark, d), "produto", "month_end", "venda")
    return got.select("produto", "month_end", r("residual", 5).alias("residual"))


@query("M5_recursive_forecast")
def recursive_forecast(spark, d):
    return fc.rolling_forecasts(panel(spark, d), chosen(spark, d), "produto", "month_end", "venda", 3, horizon=3)


@query("M6_hybrid_forecast")
def hybrid_forecast(spark, d):
    train = training(spark, d)
    best = chosen(spark, d)
    forecasts = fc.rolling_forecasts(panel(spark, d), best, "produto", "month_end", "venda", TEST_MONTHS)
    residuals = fc.residual_table(train, best, "produto", "month_end", "venda")
    return fc.hybrid_forecasts(forecasts, residuals, "produto", "month_end")


@query("M7_time_series_cv")
def time_series_cv(spark, d):
    got = fc.rolling_cv(training(spark, d), chosen(spark, d), "produto", "month_end", "venda")
    return got.groupBy("produto").agg(*[F.avg(m).alias(m) for m in ("rmse", "mae", "mape_percent")])


@query("M8_residual_correlation")
def residual_correlation(spark, d):
    train = training(spark, d)
    residuals = fc.residual_table(train, chosen(spark, d), "produto", "month_end", "venda")
    return fc.residual_correlation(residuals, train, "produto", "month_end", "dol_val")


@query("D18_component_correlation_with_residuals")
def component_correlation_residuals(spark, d):
    from terralag.operators.correlation import component_correlation

    train = training(spark, d)
    residuals = fc.residual_table(train, chosen(spark, d), "produto", "month_end", "venda")
    joined = train.join(residuals, ["produto", "month_end"], "left")
    return component_correlation(joined, "produto", "month_end", "venda", "dol_val", "residual")
