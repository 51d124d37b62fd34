"""Stand-in roles for the given tables.

The given tables have no coordinates, bands or prices, so columns are derived from them by plain
SQL expressions. The oracles use the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _as_sql(columns: dict[str, str], source: str) -> str:
    inner = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"(SELECT {inner} FROM {source})"


def _as_df(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(expr).alias(name) for name, expr in columns.items()])


# points to score, and traverse points with a target
POINT_COLUMNS = {
    "point_id": "s_suppkey",
    "px": "s_acctbal",
    "py": "CAST(s_nationkey AS DOUBLE)",
    "grp": "s_nationkey % 5",
    "target": "s_acctbal / 10000",
}
POINTS_SQL = _as_sql(POINT_COLUMNS, "supplier")

# pixels with bands; some are dark, so zero denominators occur
PIXEL_COLUMNS = {
    "pixel_id": "c_custkey",
    "x": "c_acctbal",
    "y": "CAST(c_nationkey AS DOUBLE)",
    "B02": "(c_custkey * 11) % 700 + 40",
    "B03": "(c_custkey * 31) % 1000",
    "B04": "c_nationkey * 100 + c_custkey % 50",
    "B08": "(c_custkey * 53) % 3000 + 20",
    "B11": "(c_custkey * 137) % 2900",
    "B12": "(c_custkey * 113) % 2500",
}
PIXELS_SQL = _as_sql(PIXEL_COLUMNS, "customer")

# numeric frame with planted outliers and gaps
FRAME_COLUMNS = {
    "qty": "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity END",
    "price": "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END",
    "disc": "CASE WHEN l_partkey % 89 = 0 THEN l_discount + 1 ELSE l_discount END",
    "tax": "CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE l_tax END",
}
FRAME = list(FRAME_COLUMNS)
FRAME_SQL = _as_sql({"okey": "l_orderkey", **FRAME_COLUMNS}, "lineitem")

# the same without gaps
DENSE_COLUMNS = {"qty": "l_quantity", "price": FRAME_COLUMNS["price"], "disc": FRAME_COLUMNS["disc"], "tax": "l_tax"}
DENSE_SQL = _as_sql({"okey": "l_orderkey", **DENSE_COLUMNS}, "lineitem")

# a frame with a unique id, for the imputers that need one
KEYED_COLUMNS = {
    "rid": "c_custkey",
    "a": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END",
    "b": "CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_nationkey * 300.5 END",
    "c": "(c_custkey * 37) % 5003 + c_acctbal / 3",
}
KEYED_SQL = _as_sql(KEYED_COLUMNS, "customer")

# price panel
PRICE_COLUMNS = {
    "row_id": "o_orderkey",
    "data": "CAST(o_orderdate AS DATE)",
    "produto": "o_orderpriority",
    "sigla_uf": "o_orderstatus",
    "venda": "o_totalprice / 70000",
    "compra": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 90000 + (o_custkey % 100) / 3e2 END",
}
PRICES_SQL = _as_sql(PRICE_COLUMNS, "orders")
PRODUCTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# daily exchange rate
RATE_COLUMNS = {"data": "CAST(l_shipdate AS DATE)", "valor": "l_extendedprice / 7000"}
RATES_SQL = _as_sql(RATE_COLUMNS, "lineitem")

# bands on line items, for the index functions
BAND_COLUMNS = {
    "okey": "l_orderkey",
    "B02": "l_quantity * 500 + 10",
    "B03": "l_discount * 100000",
    "B04": "l_quantity * 1000",
    "B08": "l_extendedprice",
    "B11": "l_tax * 100000",
    "B12": "l_extendedprice / 2 + l_quantity",
}
BANDS_SQL = _as_sql(BAND_COLUMNS, "lineitem")

# catalogue of scenes
SCENE_COLUMNS = {
    "scene_id": "CAST(o_orderkey AS STRING)",
    "min_lon": "-74.30 + (o_custkey % 60) * 0.01",
    "min_lat": "40.50 + (o_custkey % 50) * 0.01",
    "max_lon": "-74.20 + (o_custkey % 60) * 0.01",
    "max_lat": "40.60 + (o_custkey % 50) * 0.01",
    "time": "CAST(o_orderdate AS TIMESTAMP_NTZ)",
    "cloud_cover": "o_totalprice / 5000",
}
SCENES_SQL = _as_sql({**SCENE_COLUMNS, "scene_id": "CAST(o_orderkey AS VARCHAR)", "time": "o_orderdate"}, "orders")

# regression table: bands as features, a nonlinear target
MODEL_FEATURES = ["B02", "B03", "B04", "B08", "B11", "B12"]
MODEL_COLUMNS = {
    **PIXEL_COLUMNS,
    "uhi": "1 + 5e-2 * ((c_custkey * 53) % 3000 + 20 - c_nationkey * 100) / ((c_custkey * 53) % 3000 + 20 + c_nationkey * 100)"
    " + 1e-5 * ((c_custkey * 137) % 2900) + 1e-6 * c_acctbal",
}


def points(spark, d):
    return _as_df(table(spark, d, "supplier"), POINT_COLUMNS)


def pixels(spark, d):
    return _as_df(table(spark, d, "customer"), PIXEL_COLUMNS)


def frame(spark, d):
    return _as_df(table(spark, d, "lineitem"), {"okey": "l_orderkey", **FRAME_COLUMNS})


def dense(spark, d):
    return _as_df(table(spark, d, "lineitem"), {"okey": "l_orderkey", **DENSE_COLUMNS})


def keyed(spark, d):
    return _as_df(table(spark, d, "customer"), KEYED_COLUMNS)


def prices(spark, d):
    return _as_df(table(spark, d, "orders"), PRICE_COLUMNS)


def rates(spark, d):
    return _as_df(table(spark, d, "lineitem"), RATE_COLUMNS)


def bands(spark, d):
    return _as_df(table(spark, d, "lineitem"), BAND_COLUMNS)


def scenes(spark, d):
    return _as_df(table(spark, d, "orders"), SCENE_COLUMNS)


def model_table(spark, d):
    return _as_df(table(spark, d, "customer"), MODEL_COLUMNS)
