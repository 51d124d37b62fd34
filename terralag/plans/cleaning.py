"""Index, scalar, outlier, imputation, scaling and screening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralag.functions import indices as ix
from terralag.functions import scalars as s
from terralag.operators import compare, folds, impute, outliers as out, scaling
from terralag.operators import correlation as corr
from terralag.operators import profile as prof
from terralag.operators.pivots import impute_knn_pivots
from terralag.operators.scoring import point_features, prediction_difference
from terralag.plans import tables as t
from terralag.plans.ingest import NEAREST_SQL, r
from terralag.plans.registry import query
from terralag.plans.stats import histogram_sql, spearman_sql
from terralag.plans.tables import table
from terralag.session import cut_lineage


def norm_sql(a: str, b: str, eps: str = "1e-6") -> str:
    return f"({a} - {b}) / NULLIF({a} + {b} + {eps}, 0)"


INDEX_SQL = {
    "NDVI": norm_sql("B08", "B04"),
    "MNDWI": norm_sql("B03", "B11"),
    "NDBI": norm_sql("B11", "B08"),
    "SAVI": "(B08 - B04) * 1.5 / NULLIF(B08 + B04 + 0.500001, 0)",
    "NDMI": norm_sql("B08", "B11"),
    "NBR": norm_sql("B08", "B12"),
    "EVI": "2.5 * (B08 - B04) / NULLIF(B08 + 6 * B04 - 7.5 * B02 + 1, 0)",
}


def _index_query(name: str):
    def run(spark, d):
        rows = t.bands(spark, d)
        return rows.select("okey", "B08", r(ix.INDICES[name]()).alias("value"))

    return run


for _number, _name in enumerate(INDEX_SQL, 1):
    query(f"G{_number}_{_name.lower()}", f"SELECT okey, B08, round({INDEX_SQL[_name]}, 6) AS value FROM {t.BANDS_SQL}")(
        _index_query(_name)
    )


@query("G1_ndvi_without_epsilon", f"SELECT okey, B03, round({norm_sql('B03', 'B11', '0')}, 6) AS value FROM {t.BANDS_SQL}")
def ndvi_without_epsilon(spark, d):
    """0/0 gives NULL."""
    return t.bands(spark, d).select("okey", "B03", r(ix.normalised_difference("B03", "B11", 0.0)).alias("value"))


@query(
    "G8_distance_degrees",
    "SELECT s_suppkey, round(sqrt(power(s_acctbal - 4000, 2) + power(s_nationkey - 12, 2)), 6) AS distance FROM supplier",
)
def distance(spark, d):
    from terralag.operators.nearest import distance_degrees

    dist = distance_degrees(F.col("s_acctbal"), F.col("s_nationkey"), F.lit(4000.0), F.lit(12.0))
    return table(spark, d, "supplier").select("s_suppkey", r(dist).alias("distance"))


@query(
    "G9_parse_timestamps",
    "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS parsed FROM events",
)
def parse_timestamps(spark, d):
    text = table(spark, d, "events").select("event_id", s.format_minutes(F.col("ts")).alias("text"))
    return text.select("event_id", F.date_format(s.parse_minutes(F.col("text")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("G10_format_timestamps", "SELECT event_id, strftime(ts, '%d-%m-%Y %H:%M') AS text FROM events")
def format_timestamps(spark, d):
    return table(spark, d, "events").select("event_id", s.format_minutes(F.col("ts")).alias("text"))


@query("G11_timestamp_to_date", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def timestamp_to_date(spark, d):
    return table(spark, d, "events").select("event_id", F.to_date("ts").cast("string").alias("day"))


@query(
    "G12_to_number",
    "SELECT c_custkey, try_cast(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS DOUBLE) AS value FROM customer",
)
def to_number(spark, d):
    text = F.expr("CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE CAST(c_nationkey AS STRING) END")
    return table(spark, d, "customer").select("c_custkey", s.to_number(text).alias("value"))


@query("G13_clip", f"SELECT okey, CASE WHEN qty IS NOT NULL THEN least(greatest(qty, 10), 40) END AS qty FROM {t.FRAME_SQL}")
def clip(spark, d):
    return t.frame(spark, d).select("okey", s.clip(F.col("qty"), F.lit(10.0), F.lit(40.0)).alias("qty"))


@query("G14_mask_outside", f"SELECT okey, CASE WHEN qty BETWEEN 10 AND 40 THEN qty END AS qty FROM {t.FRAME_SQL}")
def mask_outside(spark, d):
    return t.frame(spark, d).select("okey", s.mask_outside(F.col("qty"), F.lit(10.0), F.lit(40.0)).alias("qty"))


@query("G15_round_abs_difference", f"SELECT okey, round(abs(price / 7 - 1000), 2) AS gap FROM {t.FRAME_SQL}")
def round_abs(spark, d):
    return t.frame(spark, d).select("okey", F.round(F.abs(F.col("price") / 7 - 1000), 2).alias("gap"))


@query(
    "G16_parse_name_list",
    "SELECT p_partkey, p_brand AS first, 2 AS n FROM part",
)
def parse_name_list(spark, d):
    text = F.concat(F.lit("['"), F.col("p_brand"), F.lit("', '"), F.col("p_type"), F.lit("']"))
    names = s.parse_names(text)
    return table(spark, d, "part").select(
        "p_partkey", F.element_at(names, 1).alias("first"), F.size(names).cast("bigint").alias("n")
    )


# ---- outliers


def iqr_chain(source: str, columns, factor: float, kind: str = "iqr") -> tuple[str, str]:
    """(WITH clauses, last relation) of a column-after-column filter."""
    parts, last = [], source
    for i, c in enumerate(columns):
        if kind == "iqr":
            bounds = (
                f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {last})",
                f"{c} BETWEEN q1 - {factor} * (q3 - q1) AND q3 + {factor} * (q3 - q1)",
            )
        else:
            bounds = (
                f"(SELECT any_value(md) AS md, quantile_cont(abs({c} - md), 0.5) / 0.6744897501960817 AS mad "
                f"FROM {last}, (SELECT quantile_cont({c}, 0.5) AS md FROM {last}))",
                f"(mad = 0 OR {c} BETWEEN md - {factor} * mad AND md + {factor} * mad)",
            )
        parts.append(f"k{i} AS (SELECT {last_alias(last)}.* FROM {last} {'AS src' if last == source else ''}, {bounds[0]} WHERE {bounds[1]})")
        last = f"k{i}"
    return ", ".join(parts), last


def last_alias(last: str) -> str:
    return "src" if last.startswith("(") else last


ROWS_SQL = "SELECT okey, qty, round(price, 4) AS price, round(disc, 4) AS disc, tax FROM {}"


def _rows(df):
    return df.select("okey", "qty", r("price", 4).alias("price"), r("disc", 4).alias("disc"), "tax")


def _chain_query(factor, columns, kind="iqr"):
    ctes, last = iqr_chain(t.FRAME_SQL, columns, factor, kind)
    return f"WITH {ctes} {ROWS_SQL.format(last)}"


@query("H1_iqr_sequential", _chain_query(3.0, t.FRAME))
def iqr_sequential(spark, d):
    return _rows(out.remove_outliers_iqr(t.frame(spark, d), 3.0, t.FRAME))


FACTORS = [1.5, 2.0, 4.0, 5.0]


def _factor_counts() -> str:
    parts = []
    for f in FACTORS:
        ctes, last = iqr_chain(t.FRAME_SQL, t.FRAME, f)
        parts.append(f"SELECT {f}::DOUBLE AS factor, n FROM (WITH {ctes} SELECT count(*) AS n FROM {last})")
    return " UNION ALL ".join(parts)


@query("H1_iqr_factors", _factor_counts())
def iqr_factors(spark, d):
    rows, parts = t.frame(spark, d), None
    for f in FACTORS:
        kept = out.remove_outliers_iqr(rows, f, t.FRAME).agg(F.count(F.lit(1)).alias("n"))
        part = kept.select(F.lit(f).alias("factor"), "n")
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("H2_iqr_without_target", _chain_query(3.0, ["qty", "disc", "tax"]))
def iqr_without_target(spark, d):
    return _rows(out.remove_outliers_iqr(t.frame(spark, d), 3.0, t.FRAME, target="price"))


def joint_sql(columns, factor: float) -> tuple[str, dict[str, str]]:
    stats = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in columns)
    tests = {c: f"{c} BETWEEN {c}_1 - {factor} * ({c}_3 - {c}_1) AND {c}_3 + {factor} * ({c}_3 - {c}_1)" for c in columns}
    return f"(SELECT {stats} FROM {t.FRAME_SQL})", tests


def _masked(stats: str, tests: dict[str, str]) -> str:
    cells = ", ".join(f"CASE WHEN {tests[c]} THEN {c} END AS {c}" if c in tests else c for c in t.FRAME)
    return f"(SELECT okey, {cells} FROM {t.FRAME_SQL}, {stats})"


@query("H3_iqr_to_null", ROWS_SQL.format(_masked(*joint_sql(t.FRAME, 3.0))))
def iqr_to_null(spark, d):
    return _rows(out.mask_outliers_iqr(t.frame(spark, d), 3.0, t.FRAME))


@query("H3_iqr_to_null_without_target", ROWS_SQL.format(_masked(*joint_sql(["qty", "disc", "tax"], 3.0))))
def iqr_to_null_without_target(spark, d):
    return _rows(out.mask_outliers_iqr(t.frame(spark, d), 3.0, t.FRAME, target="price"))


@query("H4_robust_z_drop", _chain_query(4.0, ["qty", "disc", "tax"], "z"))
def robust_z_drop(spark, d):
    return _rows(out.remove_outliers_robust_z(t.frame(spark, d), 4.0, t.FRAME, target="price"))


def z_sql(columns, threshold: float) -> tuple[str, dict[str, str]]:
    medians = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m" for c in columns)
    mads = ", ".join(
        f"any_value({c}_m) AS {c}_m, quantile_cont(abs({c} - {c}_m), 0.5) / 0.6744897501960817 AS {c}_d" for c in columns
    )
    stats = f"(SELECT {mads} FROM {t.FRAME_SQL}, (SELECT {medians} FROM {t.FRAME_SQL}))"
    tests = {c: f"({c}_d = 0 OR {c} BETWEEN {c}_m - {threshold} * {c}_d AND {c}_m + {threshold} * {c}_d)" for c in columns}
    return stats, tests


@query("H5_robust_z_to_null", ROWS_SQL.format(_masked(*z_sql(["qty", "disc", "tax"], 3.0))))
def robust_z_to_null(spark, d):
    return _rows(out.mask_outliers_robust_z(t.frame(spark, d), 3.0, t.FRAME, target="price"))


def winsor_sql(columns) -> str:
    stats = ", ".join(f"quantile_cont({c}, 0.05) AS {c}_l, quantile_cont({c}, 0.95) AS {c}_h" for c in columns)
    cells = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_l), {c}_h) END AS {c}" if c in columns else c for c in t.FRAME
    )
    return f"(SELECT okey, {cells} FROM {t.FRAME_SQL}, (SELECT {stats} FROM {t.FRAME_SQL}))"


@query("H6_winsorize", ROWS_SQL.format(winsor_sql(["qty", "price", "tax"])))
def winsorize(spark, d):
    return _rows(out.winsorize(t.frame(spark, d), columns=t.FRAME, target="disc"))


def _joint_filter() -> str:
    stats, tests = joint_sql(t.FRAME, 3.0)
    return f"(SELECT src.* FROM {t.FRAME_SQL} AS src, {stats} WHERE {' AND '.join(tests.values())})"


@query("H7_iqr_joint", ROWS_SQL.format(_joint_filter()))
def iqr_joint(spark, d):
    return _rows(out.remove_outliers_iqr(t.frame(spark, d), 3.0, t.FRAME, mode="joint"))


# ---- imputation


def filled_sql(agg: str) -> str:
    stats = ", ".join(f"{agg.format(c=c)} AS {c}_f" for c in t.FRAME)
    cells = ", ".join(f"round(coalesce({c}, {c}_f), 4) AS {c}" for c in t.FRAME)
    return f"SELECT okey, {cells} FROM {t.FRAME_SQL}, (SELECT {stats} FROM {t.FRAME_SQL})"


def _filled(df):
    return df.select("okey", *[r(c, 4).alias(c) for c in t.FRAME])


@query("I1_mean_fill", filled_sql("avg({c})"))
def mean_fill(spark, d):
    return _filled(impute.impute_mean(t.frame(spark, d), t.FRAME))


@query("I2_median_fill", filled_sql("quantile_cont({c}, 0.5)"))
def median_fill(spark, d):
    return _filled(impute.impute_median(t.frame(spark, d), t.FRAME))


def knn_sql(k: int) -> str:
    """Brute force: every receiver against every donor of the column."""
    columns = ("a", "b", "c")
    shared = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND s.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in columns)
    total = " + ".join(f"coalesce(power(r.{c} - s.{c}, 2), 0)" for c in columns)
    parts = [
        f"""(SELECT r.rid, list_avg(arg_min(s.{c}, (sqrt(3.0 / ({shared}) * ({total})), s.rid), {k})) AS v
        FROM base r, base s WHERE r.{c} IS NULL AND s.{c} IS NOT NULL AND ({shared}) > 0 GROUP BY r.rid) AS k{c}"""
        for c in columns
    ]
    cells = ", ".join(
        f"round(coalesce(base.{c}, k{c}.v, (SELECT avg({c}) FROM base)), 5) AS {c}" for c in columns
    )
    joins = " ".join(f"LEFT JOIN {p} ON k{c}.rid = base.rid" for c, p in zip(columns, parts))
    return f"WITH base AS {t.KEYED_SQL} SELECT base.rid, {cells} FROM base {joins}"


def _keyed(df):
    return df.select("rid", *[r(c, 5).alias(c) for c in "abc"])


@query("I3_nearest_fill_5", knn_sql(5))
def nearest_fill(spark, d):
    return _keyed(impute.impute_knn(t.keyed(spark, d), "rid", ["a", "b", "c"], 5))


@query("I3_nearest_fill_10", knn_sql(10))
def nearest_fill_10(spark, d):
    return _keyed(impute.impute_knn(t.keyed(spark, d), "rid", ["a", "b", "c"], 10))


@query("I3_nearest_fill_one_block", knn_sql(5))
def nearest_fill_one_block(spark, d):
    """The form for many columns with a single block, which is exact."""
    got = impute.impute_knn_blocks(t.keyed(spark, d), "rid", ["a", "b", "c"], 5, tables=1, block_rows=10**9)
    return _keyed(got)


BANDS = [c for c in t.PIXEL_COLUMNS if c.startswith("B")][:10]


def wide_sql(k: int) -> str:
    """Brute force over ten bands, each with gaps; distances are shared by all columns of a receiver."""
    gaps = ", ".join(f"CASE WHEN (pixel_id + {i}) % 17 <> 0 THEN CAST({c} AS DOUBLE) END AS {c}" for i, c in enumerate(BANDS))
    shared = " + ".join(f"CASE WHEN r.{c} IS NOT NULL AND s.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in BANDS)
    total = " + ".join(f"coalesce((r.{c} - s.{c}) * (r.{c} - s.{c}), 0)" for c in BANDS)
    lacking = " OR ".join(f"r.{c} IS NULL" for c in BANDS)
    best = ", ".join(f"list_avg(arg_min(s_{c}, (dist, sid), {k}) FILTER (r_{c} IS NULL AND s_{c} IS NOT NULL)) AS {c}" for c in BANDS)
    sides = ", ".join(f"r.{c} AS r_{c}, s.{c} AS s_{c}" for c in BANDS)
    cells = ", ".join(f"round(coalesce(b.{c}, k.{c}, (SELECT avg({c}) FROM base)), 5) AS {c}" for c in BANDS)
    pixels = ", ".join(f"{t.PIXEL_COLUMNS[c]} AS {c}" for c in BANDS)
    return f"""WITH base AS (SELECT pixel_id, {gaps} FROM (SELECT c_custkey AS pixel_id, {pixels} FROM customer)),
    d AS (SELECT r.pixel_id, s.pixel_id AS sid, sqrt({len(BANDS)}.0 / nullif({shared}, 0) * ({total})) AS dist, {sides} FROM base r, base s WHERE {lacking}),
    k AS (SELECT pixel_id, {best} FROM d WHERE dist IS NOT NULL GROUP BY pixel_id)
    SELECT b.pixel_id, {cells} FROM base b LEFT JOIN k ON k.pixel_id = b.pixel_id"""


def _bands_with_gaps(spark, d):
    rows = t.model_table(spark, d).select("pixel_id", *[F.col(c).cast("double").alias(c) for c in BANDS])
    return rows.withColumns({c: F.when((F.col("pixel_id") + i) % 17 != 0, F.col(c)) for i, c in enumerate(BANDS)})


@query("I3_nearest_fill_wide", wide_sql(5))
def nearest_fill_wide(spark, d):
    """Ten bands with gaps in every one, exactly, over blocks round pivots."""
    got = impute_knn_pivots(_bands_with_gaps(spark, d), "pixel_id", BANDS, 5)
    return got.select("pixel_id", *[r(c, 5).alias(c) for c in BANDS])


@query("I3_nearest_fill_wide_blocks")
def nearest_fill_wide_blocks(spark, d):
    """The same table filled from blocks of random projections, which is approximate."""
    return impute.impute_knn_blocks(_bands_with_gaps(spark, d), "pixel_id", BANDS, 5)


@query("I4_iterative_fill")
def iterative_fill(spark, d):
    return _filled(impute.impute_iterative(t.frame(spark, d), t.FRAME, max_iter=20))


@query(
    "I5_fill_series",
    """SELECT k, CAST(month_end AS VARCHAR) AS month_end, round(coalesce(
      last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY month_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY month_end ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS v
    FROM (SELECT produto AS k, month_end, CASE WHEN month(month_end) % 3 = 0 THEN venda END AS v FROM
      (SELECT produto, last_day(data) AS month_end, avg(venda) AS venda FROM """
    + t.PRICES_SQL
    + """ GROUP BY 1, 2))""",
)
def fill_series(spark, d):
    from terralag.operators.series import fill_panel, monthly_mean

    panel = monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"]).select(
        F.col("produto").alias("k"), "month_end", F.when(F.month("month_end") % 3 == 0, F.col("venda")).alias("v")
    )
    got = fill_panel(panel, "k", "month_end", "v")
    return got.select("k", F.col("month_end").cast("string").alias("month_end"), r("v").alias("v"))


# ---- scaling and univariate selection


def scaled_sql(shift: str, scale: str) -> str:
    stats = ", ".join(f"{shift.format(c=c)} AS {c}_s, {scale.format(c=c)} AS {c}_w" for c in t.FRAME)
    cells = ", ".join(f"round(({c} - {c}_s) / {c}_w, 6) AS {c}" for c in t.FRAME)
    return f"SELECT okey, {cells} FROM {t.DENSE_SQL}, (SELECT {stats} FROM {t.DENSE_SQL})"


def _scaled(df):
    return df.select("okey", *[r(c).alias(c) for c in t.FRAME])


@query("J1_standard_scale", scaled_sql("avg({c})", "stddev_pop({c})"))
def standard_scale(spark, d):
    return _scaled(scaling.standard_scale(t.dense(spark, d), t.FRAME))


@query("J2_minmax_scale", scaled_sql("min({c})", "(max({c}) - min({c}))"))
def minmax_scale(spark, d):
    return _scaled(scaling.minmax_scale(t.dense(spark, d), t.FRAME))


@query(
    "J3_robust_scale",
    scaled_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"),
)
def robust_scale(spark, d):
    return _scaled(scaling.robust_scale(t.dense(spark, d), t.FRAME))


@query(
    "J4_quantile_uniform",
    f"""WITH q AS (SELECT unnest(range(0, 100)) AS i, unnest(quantile_cont(price, {[i / 99 for i in range(100)]})) AS v FROM {t.DENSE_SQL}),
    u AS (SELECT v, min(i) / 99.0 AS g_first, max(i) / 99.0 AS g_last FROM q GROUP BY v),
    s AS (SELECT *, lead(v) OVER (ORDER BY v) AS v2, lead(g_first) OVER (ORDER BY v) AS g2 FROM u)
    SELECT okey, round(price, 4) AS price, round(CASE WHEN price <= (SELECT min(v) FROM u) THEN 0 WHEN price >= (SELECT max(v) FROM u) THEN 1
      WHEN price = s.v THEN (g_first + g_last) / 2 ELSE g_last + (g2 - g_last) * (price - s.v) / (v2 - s.v) END, 6) AS value
    FROM (SELECT okey, price FROM {t.DENSE_SQL}) p ASOF JOIN s ON p.price >= s.v""",
)
def quantile_uniform(spark, d):
    rows = t.dense(spark, d).select("okey", "price", F.col("price").alias("value"))
    got = scaling.quantile_transform(rows, ["value"], 100, "uniform")
    return got.select("okey", r("price", 4).alias("price"), r("value").alias("value"))


@query(
    "J4_quantile_fit_apply",
    f"""WITH q AS (SELECT unnest(range(0, 100)) AS i, unnest(quantile_cont(price, {[i / 99 for i in range(100)]})) AS v FROM {t.DENSE_SQL} WHERE okey % 3 <> 0),
    u AS (SELECT v, min(i) / 99.0 AS g_first, max(i) / 99.0 AS g_last FROM q GROUP BY v),
    s AS (SELECT *, lead(v) OVER (ORDER BY v) AS v2, lead(g_first) OVER (ORDER BY v) AS g2 FROM u)
    SELECT okey, round(price, 4) AS price, round(CASE WHEN price <= (SELECT min(v) FROM u) THEN 0 WHEN price >= (SELECT max(v) FROM u) THEN 1
      WHEN price = s.v THEN (g_first + g_last) / 2 ELSE g_last + (g2 - g_last) * (price - s.v) / (v2 - s.v) END, 6) AS value
    FROM (SELECT okey, price FROM {t.DENSE_SQL} WHERE okey % 3 = 0) p ASOF LEFT JOIN s ON p.price >= s.v""",
)
def quantile_fit_apply(spark, d):
    """Fitted on two thirds of the orders by the way of large columns, applied to the others."""
    rows = t.dense(spark, d).select("okey", "price", F.col("price").alias("value"))
    points = scaling.fit_quantiles(rows.where("okey % 3 <> 0"), ["value"], 100, limit=100)
    got = scaling.apply_quantiles(rows.where("okey % 3 = 0"), points, "uniform")
    return got.select("okey", r("price", 4).alias("price"), r("value").alias("value"))


def _probit_sql(p: str) -> str:
    """The normal quantile by the same rational approximation, in SQL."""

    def horner(coefficients, x):
        out = f"({coefficients[0]!r}::DOUBLE)"
        for c in coefficients[1:]:
            out = f"({out} * {x} + ({c!r}))"
        return out

    r, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda x: f"{horner(scaling._TAIL_NUM, x)} / {horner(scaling._TAIL_DEN, x)}"
    clip = scaling._NORMAL_CLIP
    return f"""greatest(least(CASE WHEN {p} <= 1e-7 THEN -{clip} WHEN {p} >= 1 - 1e-7 THEN {clip} WHEN {p} < {scaling._TAIL_AT} THEN {tail(low)}
      WHEN {p} > 1 - {scaling._TAIL_AT} THEN -({tail(high)}) ELSE {r} * {horner(scaling._CENTRE_NUM, f"({r} * {r})")} / {horner(scaling._CENTRE_DEN, f"({r} * {r})")} END, {clip}), -{clip})"""


def _normal_sql(c: str) -> str:
    return f"""(WITH q AS (SELECT unnest(range(0, 100)) AS i, unnest(quantile_cont({c}, {[i / 99 for i in range(100)]})) AS v FROM {t.DENSE_SQL}),
    u AS (SELECT v, min(i) / 99.0 AS g_first, max(i) / 99.0 AS g_last FROM q GROUP BY v),
    s AS (SELECT *, lead(v) OVER (ORDER BY v) AS v2, lead(g_first) OVER (ORDER BY v) AS g2 FROM u),
    p AS (SELECT i, (CASE WHEN x <= (SELECT min(v) FROM u) THEN 0 WHEN x >= (SELECT max(v) FROM u) THEN 1
      WHEN x = s.v THEN (g_first + g_last) / 2 ELSE g_last + (g2 - g_last) * (x - s.v) / (v2 - s.v) END)::DOUBLE AS p
      FROM (SELECT i, {c} AS x FROM base) d ASOF JOIN s ON d.x >= s.v)
    SELECT i, round({_probit_sql("p")}, 6) AS {c} FROM p)"""


@query(
    "J4_quantile_normal",
    f"""WITH base AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM {t.DENSE_SQL})
    SELECT okey, a.qty, b.price, round(disc, 6) AS disc, round(tax, 6) AS tax FROM base JOIN {_normal_sql("qty")} a USING (i) JOIN {_normal_sql("price")} b USING (i)""",
)
def quantile_normal(spark, d):
    return _scaled(scaling.quantile_transform(t.dense(spark, d), ["qty", "price"], 100, "normal"))


@query(
    "J5_polynomial_features",
    f"""SELECT okey, round(disc * disc, 8) AS dd, round(disc * tax, 8) AS dt, round(tax * tax, 8) AS tt, round(disc * disc * disc, 8) AS ddd,
    round(disc * disc * tax, 8) AS ddt, round(disc * tax * tax, 8) AS dtt, round(tax * tax * tax, 8) AS ttt FROM {t.DENSE_SQL}""",
)
def polynomial(spark, d):
    got = scaling.polynomial_features(t.dense(spark, d).select("okey", "disc", "tax"), ["disc", "tax"], 3)
    names = ["disc*disc", "disc*tax", "tax*tax", "disc*disc*disc", "disc*disc*tax", "disc*tax*tax", "tax*tax*tax"]
    short = {n: "".join(part[0] for part in n.split("*")) for n in names}
    return got.select("okey", *[r(F.col(f"`{n}`"), 8).alias(a) for n, a in short.items()])


@query(
    "J6_variance_threshold",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\" FROM {t.DENSE_SQL} HAVING var_pop({c}) > 0.001" for c in t.FRAME
    ),
)
def variance_threshold(spark, d):
    kept = scaling.variance_threshold(t.dense(spark, d), t.FRAME, 0.001)
    return spark.createDataFrame([(c,) for c in kept], "column string")


SCORED = ["B02", "B03", "B04", "B08", "B11", "B12"]


@query(
    "J7_select_k_best",
    "SELECT \"column\", f_score FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(power(corr({c}, x), 2) / (1 - power(corr({c}, x), 2)) * (count(*) - 2), 5) AS f_score FROM {t.PIXELS_SQL}"
        for c in SCORED
    )
    + ") ORDER BY f_score DESC LIMIT 5",
)
def k_best(spark, d):
    got = scaling.select_k_best(t.pixels(spark, d), SCORED, "x", 5)
    return got.select("column", r("f_score", 5).alias("f_score"))


HASH_SQL = "('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 8))::BIGINT"


@query(
    "J11_train_test_split",
    f"SELECT o_orderkey, CASE WHEN {HASH_SQL} % 1000 < 250 THEN 'test' ELSE 'train' END AS part FROM orders",
)
def train_test(spark, d):
    return folds.train_test_split(table(spark, d, "orders"), "o_orderkey", 0.25).select("o_orderkey", "part")


@query("J12_k_folds", f"SELECT o_orderkey, {HASH_SQL} % 5 AS fold FROM orders")
def k_folds(spark, d):
    got = folds.k_folds(table(spark, d, "orders"), "o_orderkey", 5)
    return got.select("o_orderkey", F.col("fold").cast("bigint").alias("fold"))


# ---- comparison reports


def matrix_sql() -> str:
    """The 7 x 3 cells without model-based fills, each spelled out."""
    features = ["qty", "disc", "tax"]
    sources = {"none": f"(SELECT * FROM {t.FRAME_SQL})"}
    for name, columns, factor, kind in (
        ("iqr", t.FRAME, 3.0, "iqr"),
        ("iqr_drop", features, 3.0, "iqr"),
        ("zscore_drop", features, 4.0, "z"),
    ):
        ctes, last = iqr_chain(t.FRAME_SQL, columns, factor, kind)
        sources[name] = f"(WITH {ctes} SELECT * FROM {last})"
    sources["iqr_nan"] = _masked(*joint_sql(features, 3.0))
    sources["zscore_nan"] = _masked(*z_sql(features, 3.0))
    sources["winsorize"] = winsor_sql(features)
    parts = []
    for m in compare.OUTLIER_METHODS:
        for f, agg in (("none", None), ("mean", "avg({c})"), ("median", "quantile_cont({c}, 0.5)")):
            src = f"m_{m}"
            if agg:
                stats = ", ".join(f"{agg.format(c=c)} AS {c}_f" for c in t.FRAME)
                cells = ", ".join(f"coalesce({c}, {c}_f) AS {c}" for c in t.FRAME)
                src = f"(SELECT okey, {cells} FROM m_{m}, (SELECT {stats} FROM m_{m}))"
            src = f"(SELECT * FROM {src} WHERE price IS NOT NULL)"
            rhos = " UNION ALL ".join(f"SELECT rho FROM {spearman_sql(src, c, 'price')}" for c in features)
            parts.append(
                f"SELECT '{m}' AS outlier_method, '{f}' AS imputation_method, "
                f"(SELECT round(avg(abs(rho)), 6) FROM ({rhos})) AS avg_abs_corr_with_target, "
                f"(SELECT count(*) FROM {src}) AS n_samples"
            )
    ctes = ", ".join(f"m_{m} AS MATERIALIZED {sql}" for m, sql in sources.items())
    return f"WITH {ctes} {' UNION ALL '.join(parts)}"


def _matrix(df):
    return df.select(
        "outlier_method", "imputation_method", r("avg_abs_corr_with_target").alias("avg_abs_corr_with_target"), "n_samples"
    )


@query("L10_method_matrix", matrix_sql())
def method_matrix(spark, d):
    return _matrix(compare.method_matrix(t.frame(spark, d), "okey", t.FRAME, "price"))


@query("L10_method_matrix_model_fills")
def method_matrix_models(spark, d):
    got = compare.method_matrix(
        t.keyed(spark, d), "rid", ["a", "b", "c"], "c", fill_methods=(), model_methods=compare.MODEL_METHODS
    )
    return _matrix(got)


@query("L10_materialised_cell", f"""WITH m AS {_masked(*joint_sql(["qty", "disc", "tax"], 3.0))}
    SELECT okey, {", ".join(f"round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM m)), 4) AS {c}" for c in t.FRAME)} FROM m""")
def materialised_cell(spark, d):
    return _filled(compare.materialise_cell(t.frame(spark, d), t.FRAME, "price"))


DIFFERENCE_SQL = "(SELECT o_orderkey AS row_id, o_totalprice / 70000 - (o_totalprice / 71000 + (o_custkey % 10) / 100.0) AS diff FROM orders)"


@query("L11_prediction_difference", histogram_sql(DIFFERENCE_SQL, "diff", 10))
def difference_report(spark, d):
    orders = table(spark, d, "orders")
    a = orders.selectExpr("o_orderkey AS row_id", "o_totalprice / 70000 AS diff")
    b = orders.selectExpr("o_orderkey AS row_id", "o_totalprice / 71000 + (o_custkey % 10) / 100.0 AS diff")
    return prof.histogram(prediction_difference(a, b, "row_id", ["diff"]), "diff", 10)


@query(
    "L12_strong_pairs",
    "SELECT a, b, rho FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(rho, 6) AS rho FROM {spearman_sql(t.PIXELS_SQL, a, b)}"
        for i, a in enumerate(["x", "y", *SCORED])
        for b in ["x", "y", *SCORED][i + 1 :]
    )
    + ") WHERE abs(rho) > 0.3",
)
def strong_pairs(spark, d):
    rho = corr.spearman_matrix(t.pixels(spark, d), ["x", "y", *SCORED])
    return corr.strong_pairs(rho, 0.3).select("a", "b", r("rho").alias("rho"))


# ---- the whole feature build


FLAG_COLUMNS = ["NDVI", "MNDWI", "NDBI", "SAVI"]


def _flagship_sql() -> str:
    cells = ", ".join(f"{INDEX_SQL[c]} AS {c}" for c in FLAG_COLUMNS)
    base = f"(SELECT p.grp, p.target, {cells} FROM {NEAREST_SQL} n JOIN {t.POINTS_SQL} p USING (point_id) JOIN {t.PIXELS_SQL} q ON q.pixel_id = n.pixel_id)"
    ctes, last = iqr_chain(base, FLAG_COLUMNS, 3.0)
    means = ", ".join(f"round(avg({c}), 6) AS {c}" for c in FLAG_COLUMNS)
    return f"WITH {ctes} SELECT grp, count(*) AS n, {means}, round(avg(target), 6) AS target FROM {last} GROUP BY grp"


@query("feature_table_by_group", _flagship_sql())
def flagship(spark, d):
    """Nearest pixel per point, indices, outlier removal, means per group."""
    rows = point_features(
        t.points(spark, d), t.pixels(spark, d), "point_id", "pixel_id", ("px", "py"), ("x", "y"), FLAG_COLUMNS
    )
    # the filter reads its input once per column, so the join result is staged
    staged = cut_lineage(rows.select("grp", "target", *FLAG_COLUMNS))
    clean = out.remove_outliers_iqr(staged, 3.0, FLAG_COLUMNS)
    return clean.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), *[r(F.avg(c)).alias(c) for c in FLAG_COLUMNS], r(F.avg("target")).alias("target")
    )
