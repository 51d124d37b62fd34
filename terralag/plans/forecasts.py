"""Queries on seasonal models, their saved state, their residuals, and linear searches from moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralag.operators import diagnostics as diag
from terralag.operators import forecast_state as state
from terralag.operators import forecasting as fc
from terralag.plans.ingest import r
from terralag.plans.modelling import SERIES_SQL, first_order, panel, training
from terralag.plans.registry import query
from terralag.session import new_path


def ordered_as(spark, d, order):
    """The same order for every series."""
    return first_order(spark, d).withColumns({f: F.lit(v) for f, v in zip(fc.ORDER_FIELDS, order)})


# u = y - S l12 and v = l1 - S l13 for a seasonal coefficient S; the plain one is then a regression of u on v
_PROFILE = """SELECT produto, s, (yx - s * (y13 + l12x) + s * s * l1213) / (xx - 2 * s * x13 + s * s * l1313) AS f,
      yy - 2 * s * y12 + s * s * l1212 - pow(yx - s * (y13 + l12x) + s * s * l1213, 2) / (xx - 2 * s * x13 + s * s * l1313) AS sse
    FROM sums JOIN {} USING (produto)"""


@query(
    "M1_seasonal_products",
    f"""WITH series AS {SERIES_SQL},
    lags AS (SELECT produto, y, l1 AS x, lag(y, 12) OVER w AS l12, lag(y, 13) OVER w AS l13 FROM series WINDOW w AS (PARTITION BY produto ORDER BY month_end)),
    sums AS (SELECT produto, sum(y * y) AS yy, sum(y * x) AS yx, sum(x * x) AS xx, sum(y * l12) AS y12, sum(l12 * l12) AS l1212, sum(y * l13) AS y13,
      sum(l12 * x) AS l12x, sum(l12 * l13) AS l1213, sum(x * l13) AS x13, sum(l13 * l13) AS l1313 FROM lags WHERE l13 IS NOT NULL GROUP BY produto),
    coarse AS ({_PROFILE.format("(SELECT produto, g / 1000.0 AS s FROM sums, range(-1500, 1501) k(g))")}),
    near AS (SELECT produto, arg_min(s, sse) AS s FROM coarse GROUP BY produto),
    fine AS ({_PROFILE.format("(SELECT produto, s + g / 1000000.0 AS s FROM near, range(-1500, 1501) k(g))")})
    SELECT produto, round(arg_min(f, sse), 4) AS plain, round(arg_min(s, sse), 4) AS seasonal, round(min(sse), 3) AS sse FROM fine GROUP BY produto""",
)
def seasonal_products(spark, d):
    """(1, 0, 0)(1, 0, 0, 12): the product of two first-order polynomials, four coefficients from two."""
    models = state.fit_models(panel(spark, d), ordered_as(spark, d, (1, 0, 0, 1, 0, 0)), "produto", "month_end", "venda")
    coef = lambda i: F.element_at("coef", i)
    return models.select("produto", F.round(coef(1), 4).alias("plain"), F.round(coef(2), 4).alias("seasonal"), r("sse", 3).alias("sse"))


@query("M1_seasonal_orders")
def seasonal_orders(spark, d):
    """All coefficients of (1, 0, 1)(1, 0, 1, 12) for every series."""
    models = state.fit_models(training(spark, d), ordered_as(spark, d, (1, 0, 1, 1, 0, 1)), "produto", "month_end", "venda")
    return models.select("produto", *fc.ORDER_FIELDS, "coef", "n", "sse", "aic")


@query(
    "A11_forecast_models_saved",
    f"""WITH s AS {SERIES_SQL}, c AS (SELECT produto, sum(y * l1) / sum(l1 * l1) AS b, arg_max(y, i) AS y, max(month_end) AS month_end FROM s GROUP BY produto)
    SELECT produto, last_day(month_end + to_months(step)) AS month_end, step, round(y * pow(b, step), 5) AS predicted FROM c, (VALUES (1), (2), (3)) v(step)""",
)
def forecast_models_saved(spark, d):
    """Models are fitted, written, read again and asked for three months past the series."""
    path = new_path(spark, "models")
    state.save_models(state.fit_models(panel(spark, d), first_order(spark, d), "produto", "month_end", "venda"), path)
    ahead = state.forecast_models(state.load_models(spark, path), "produto", "month_end", 3)
    return ahead.select("produto", "month_end", "step", r("predicted", 5).alias("predicted"))


def _first_residuals(spark, d):
    return fc.residual_table(panel(spark, d), first_order(spark, d), "produto", "month_end", "venda")


_RESIDUALS = f"""s AS {SERIES_SQL}, b AS (SELECT produto, sum(y * l1) / sum(l1 * l1) AS b FROM s GROUP BY 1),
    raw AS (SELECT produto, month_end, y - b * l1 AS e FROM s JOIN b USING (produto) WHERE l1 IS NOT NULL),
    c AS (SELECT *, e - avg(e) OVER (PARTITION BY produto) AS z, row_number() OVER (PARTITION BY produto ORDER BY month_end) AS i, count(*) OVER (PARTITION BY produto) AS n FROM raw)"""


@query(
    "M8_residual_portmanteau",
    f"""WITH {_RESIDUALS}, lagged AS (SELECT a.produto, a.n, b.i - a.i AS lag, sum(a.z * b.z) AS s FROM c a JOIN c b ON a.produto = b.produto AND b.i - a.i BETWEEN 0 AND 12 GROUP BY 1, 2, 3),
    rs AS (SELECT l.produto, l.n, l.lag, l.s / z.s AS r FROM lagged l JOIN lagged z ON l.produto = z.produto AND z.lag = 0 WHERE l.lag > 0),
    qs AS (SELECT *, n * (n + 2) * sum(r * r / (n - lag)) OVER (PARTITION BY produto ORDER BY lag) AS q FROM rs)
    SELECT produto, lag, round(r, 6) AS r, round(q, 4) AS q, round(exp(-q / 2) * list_sum(list_transform(range(lag // 2), lambda k: pow(q / 2, k) / factorial(k::INTEGER))), 6) AS p_value
    FROM qs WHERE lag % 2 = 0""",
)
def residual_portmanteau(spark, d):
    """Even lags only: their tails have a closed form."""
    got = diag.autocorrelations(_first_residuals(spark, d), "produto", "month_end", 12).filter("lag % 2 = 0")
    return got.select("produto", F.col("lag").cast("bigint").alias("lag"), r("r").alias("r"), r("q", 4).alias("q"), r("p_value").alias("p_value"))


@query(
    "M8_residual_normality",
    f"""WITH {_RESIDUALS}, m AS (SELECT produto, count(*) AS n, avg(e) AS mean, avg(z * z) AS m2, avg(z * z * z) AS m3, avg(z * z * z * z) AS m4,
      sum(e * e) FILTER (i > n - n // 3) / sum(e * e) FILTER (i <= n // 3) AS spread_ratio FROM c GROUP BY produto),
    j AS (SELECT *, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) AS kurtosis FROM m),
    k AS (SELECT *, n / 6.0 * (skewness * skewness + (kurtosis - 3) * (kurtosis - 3) / 4) AS jb FROM j)
    SELECT produto, n, round(mean, 4) AS mean, round(sqrt(m2), 4) AS spread, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(jb, 5) AS jarque_bera,
      round(exp(-jb / 2), 6) AS p_value, round(spread_ratio, 6) AS spread_ratio FROM k""",
)
def residual_normality(spark, d):
    got = diag.normality(_first_residuals(spark, d), "produto", "month_end")
    digits = {"mean": 4, "spread": 4, "skewness": 6, "kurtosis": 6, "jarque_bera": 5, "p_value": 6, "spread_ratio": 6}
    return got.select("produto", "n", *[r(c, n).alias(c) for c, n in digits.items()])


@query(
    "M8_residual_normal_plot",
    f"""WITH {_RESIDUALS} SELECT produto, month_end, round(z / sqrt(avg(z * z) OVER (PARTITION BY produto)), 6) AS standardised,
    round((row_number() OVER (PARTITION BY produto ORDER BY z, month_end) - 0.375) / (n + 0.25), 6) AS place FROM c""",
)
def residual_normal_plot(spark, d):
    got = diag.normal_scores(_first_residuals(spark, d), "produto", "month_end")
    return got.select("produto", "month_end", r("standardised").alias("standardised"), r("place").alias("place"))
