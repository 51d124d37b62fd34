"""Linear models from moments: searches without refits, the lasso path, robust and kernel regression, collinearity."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralag.operators import moments as mo
from terralag.operators.models import make_pipeline
from terralag.plans import tables as t
from terralag.plans.ingest import r
from terralag.plans.modelling import LABEL, folded
from terralag.plans.registry import query

TWO = ["B08", "B04"]
_TWO_SQL = f"""(SELECT c_custkey AS pixel_id, CAST({t.PIXEL_COLUMNS['B08']} AS DOUBLE) AS x, CAST({t.PIXEL_COLUMNS['B04']} AS DOUBLE) AS z, {t.MODEL_COLUMNS['uhi']} AS y,
    ('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|42'), 1, 8))::BIGINT % {{}} AS fold FROM customer)"""


@query(
    "J10_forward_selection_linear",
    f"""WITH m AS {_TWO_SQL.format(10)},
    s AS (SELECT f AS fold, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy
      FROM m, range(0, 10) r(f) WHERE m.fold <> f GROUP BY f),
    c AS (SELECT fold, 1 AS num_features, xy / xx AS bx, 0.0::DOUBLE AS bz, mx, mz, my FROM s UNION ALL
      SELECT fold, 2, (xy * zz - zy * xz) / (xx * zz - xz * xz), (zy * xx - xy * xz) / (xx * zz - xz * xz), mx, mz, my FROM s),
    e AS (SELECT fold, num_features, y, y - my - bx * (x - mx) - bz * (z - mz) AS e FROM m JOIN c USING (fold)),
    g AS (SELECT fold, num_features, 1 - avg(e * e) / var_pop(y) AS r2, avg(abs(e / y)) AS mape FROM e GROUP BY 1, 2)
    SELECT num_features, round(avg(r2), 8) AS r2_mean, round(stddev_pop(r2), 8) AS r2_std, round(avg(mape), 8) AS mape_mean, round(stddev_pop(mape), 8) AS mape_std FROM g GROUP BY 1""",
)
def forward_selection_linear(spark, d):
    """Ten folds, every prefix: two scans."""
    got = mo.linear_forward_selection(folded(spark, d, 10), TWO, LABEL)
    return got.select("num_features", *[r(c, 8).alias(c) for c in ("r2_mean", "r2_std", "mape_mean", "mape_std")])


@query("J10_forward_selection_linear_all")
def forward_selection_linear_all(spark, d):
    """All features, ten folds."""
    return mo.linear_forward_selection(folded(spark, d, 10), t.MODEL_FEATURES, LABEL)


@query(
    "L6_subset_search_linear",
    f"""WITH m AS {_TWO_SQL.format(5)}, v AS (SELECT 'B08' AS feature, fold, x, y FROM m UNION ALL SELECT 'B04', fold, z, y FROM m),
    s AS (SELECT feature, f AS fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, covar_pop(x, y) AS xy FROM v, range(0, 5) r(f) WHERE v.fold <> f GROUP BY 1, 2),
    c AS (SELECT feature, fold, alpha, n * xy / (n * xx + alpha) AS b, mx, my FROM s, (VALUES (0.0), (1e8), (1e9)) a(alpha)),
    g AS (SELECT feature, alpha::DOUBLE AS alpha, fold, 1 - avg(pow(y - my - b * (x - mx), 2)) / var_pop(y) AS r2, avg(abs((y - my - b * (x - mx)) / y)) AS mape FROM v JOIN c USING (feature, fold) GROUP BY 1, 2, 3)
    SELECT feature, alpha, round(avg(r2), 8) AS r2_mean, round(avg(mape), 8) AS mape_mean FROM g GROUP BY 1, 2""",
)
def subset_search_linear(spark, d):
    """Subsets by ridge penalties over five folds: still two scans."""
    got = mo.linear_scores(folded(spark, d, 5), [["B08"], ["B04"]], LABEL, (0.0, 1e8, 1e9))
    means = got.groupBy(F.element_at("features", 1).alias("feature"), "alpha").agg(F.avg("r2").alias("r2_mean"), F.avg("mape_fraction").alias("mape_mean"))
    return means.select("feature", "alpha", r("r2_mean", 8).alias("r2_mean"), r("mape_mean", 8).alias("mape_mean"))


@query("L6_subset_search_linear_grid")
def subset_search_linear_grid(spark, d):
    """Every prefix of the features by 27 penalties over five folds, best first."""
    prefixes = [t.MODEL_FEATURES[:n] for n in range(1, len(t.MODEL_FEATURES) + 1)]
    got = mo.linear_scores(folded(spark, d, 5), prefixes, LABEL, [0.0, *(10.0 ** (k / 2) for k in range(-8, 18))])
    means = got.groupBy("model", "features", "alpha").agg(F.avg("r2").alias("r2_mean"), F.avg("mape_fraction").alias("mape_mean"))
    return means.orderBy("mape_mean", "model")


_LASSO_ONE = """SELECT round(sign(c) * greatest(abs(c) - alpha * l1, 0) / (v + alpha * (1 - l1)), 7) AS coefficient, model FROM (
    SELECT covar_pop(x, y) AS c, var_pop(x) AS v FROM (SELECT CAST({} AS DOUBLE) AS x, {} AS y FROM customer)),
    (VALUES ('lasso', 0.02, 1.0), ('elastic_net', 0.04, 0.25)) m(model, alpha, l1)"""


@query("K8_lasso_one_feature", _LASSO_ONE.format(t.PIXEL_COLUMNS["B08"], t.MODEL_COLUMNS["uhi"]))
def lasso_one_feature(spark, d):
    rows = t.model_table(spark, d)
    fits = {"lasso": {"alpha": 0.02}, "elastic_net": {"alpha": 0.04, "l1_ratio": 0.25}}
    found = [(m, float(make_pipeline(m, ["B08"], LABEL, **p).fit(rows).stages[-1].coefficients[0])) for m, p in fits.items()]
    got = spark.createDataFrame(found, "model string, coefficient double")
    return got.select("model", r("coefficient", 7).alias("coefficient"))


@query(
    "K8_lasso_path_two_features",
    f"""WITH v AS (SELECT covar_pop(x, y) / stddev_pop(x) AS a, covar_pop(z, y) / stddev_pop(z) AS b, corr(x, z) AS p, stddev_pop(x) AS sx, stddev_pop(z) AS sz FROM {_TWO_SQL.format(3)}),
    k AS (SELECT *, share, greatest(abs(a), abs(b)) * share AS l FROM v, (VALUES (0.75), (0.25), (0.05), (0.0)) h(share)),
    c AS (SELECT *, CASE WHEN s = 0 THEN 0 WHEN u = 0 THEN a - l * s ELSE (a - l * s - p * (b - l * u)) / (1 - p * p) END AS f,
      CASE WHEN u = 0 THEN 0 WHEN s = 0 THEN b - l * u ELSE (b - l * u - p * (a - l * s)) / (1 - p * p) END AS g FROM k, (VALUES (-1), (0), (1)) i(s), (VALUES (-1), (0), (1)) j(u))
    SELECT share::DOUBLE AS share, round(f / sx, 8) AS first, round(g / sz, 8) AS second FROM c
    WHERE sign(f) = s AND sign(g) = u AND (s <> 0 OR abs(a - p * g) <= l + 1e-12) AND (u <> 0 OR abs(b - p * f) <= l + 1e-12)""",
)
def lasso_path_two(spark, d):
    """The path at four shares of its largest penalty, against the closed form of each sign pattern."""
    knots = mo.lasso_path(mo.grouped_moments(t.model_table(spark, d), [*TWO, LABEL])[None])
    rows = [(s, *(round(float(b), 8) for b in mo.lasso_at(knots, knots[0][0] * s))) for s in (0.75, 0.25, 0.05, 0.0)]
    return spark.createDataFrame(rows, "share double, first double, second double")


def _terms(spark, fit, features):
    rows = [("intercept", float(fit.intercept)), *zip(features, map(float, fit.coefficients))]
    return spark.createDataFrame(rows, "term string, weight double")


@query("K8_lasso_path_choice")
def lasso_path_choice(spark, d):
    """All features: the knots chosen by two criteria, from one scan."""
    m = mo.grouped_moments(t.model_table(spark, d), [*t.MODEL_FEATURES, LABEL])[None]
    aic, bic = (_terms(spark, mo.choose_lasso(m, c), t.MODEL_FEATURES).withColumn("criterion", F.lit(c)) for c in ("aic", "bic"))
    return aic.unionByName(bic)


@query("K8_median_regression_constant", f"SELECT round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.9), 6) AS upper FROM (SELECT {t.MODEL_COLUMNS['uhi']} AS y FROM customer)")
def median_constant(spark, d):
    """Quantile regression without features is the quantile."""
    rows = t.model_table(spark, d)
    found = [tuple(mo.quantile_regression(rows, [], LABEL, q).intercept for q in (0.5, 0.9))]
    return spark.createDataFrame(found, "median double, upper double").select(r("median").alias("median"), r("upper").alias("upper"))


@query("K8_robust_regressions")
def robust_regressions(spark, d):
    """Huber, median and consensus lines over all features."""
    rows, names = t.model_table(spark, d), t.MODEL_FEATURES
    fits = {"huber": mo.huber(rows, names, LABEL), "median": mo.quantile_regression(rows, names, LABEL), "consensus": mo.consensus(rows, names, LABEL, "pixel_id")}
    parts = [_terms(spark, f, names).withColumn("model", F.lit(m)) for m, f in fits.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("K8_kernel_regression")
def kernel_regression(spark, d):
    """Error of the kernel fit on its rows beside that of the mean and of the line."""
    from pyspark.sql.types import DoubleType

    rows = mo.complete(t.model_table(spark, d), [*t.MODEL_FEATURES, LABEL])
    fit = mo.kernel_regression(rows, t.MODEL_FEATURES, LABEL)

    @F.pandas_udf(DoubleType())
    def guess(*columns):
        import numpy as np
        import pandas as pd

        return pd.Series(fit.predict(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    intercept, coef = mo.solve(mo.grouped_moments(rows, [*t.MODEL_FEATURES, LABEL])[None])
    scored = rows.select(F.col(LABEL).alias("y"), guess(*t.MODEL_FEATURES).alias("kernel"), mo._linear(intercept, coef, t.MODEL_FEATURES).alias("linear"))
    scored = scored.withColumn("mean", F.lit(float(scored.agg(F.avg("y")).first()[0])))
    return scored.agg(*[F.sqrt(F.avg((F.col("y") - F.col(c)) * (F.col("y") - F.col(c)))).alias(f"{c}_rmse") for c in ("kernel", "linear", "mean")])


@query(
    "L12_collinearity_two",
    f"""WITH c AS (SELECT corr(x, z) AS p FROM {_TWO_SQL.format(3)}) SELECT f AS "column", round(1 / (1 - p * p), 6) AS vif, round(p * p, 6) AS r2,
    CASE WHEN abs(p) > 0.5 THEN 1 END AS "group" FROM c, (VALUES ('B08'), ('B04')) v(f)""",
)
def collinearity_two(spark, d):
    got = mo.collinearity(t.model_table(spark, d), TWO, 0.5)
    return got.select("column", r("vif").alias("vif"), r("r2").alias("r2"), "group")


@query("L12_collinearity_groups")
def collinearity_groups(spark, d):
    return mo.collinearity(t.model_table(spark, d), t.MODEL_FEATURES, 0.9)
