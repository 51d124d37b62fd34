"""Sources, sinks and simple relational queries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F, types as T

from terralag.functions import scalars as s
from terralag.operators import relational as rel
from terralag.operators.models import load_model, save_model
from terralag.operators.nearest import degrees_to_metres, nearest_join
from terralag.operators.scoring import submission
from terralag.plans import tables as t
from terralag.plans.registry import query
from terralag.plans.tables import table
from terralag.schemas import numeric_columns
from terralag.session import new_path
from terralag.sources import files, tiles


def r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query("A1_csv_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def csv_scan(spark, d):
    path = new_path(spark, "orders-csv")
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    files.write_table(table(spark, d, "orders").select(*columns), path, "csv")
    return files.read_csv(
        spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"
    )


@query(
    "A2_decimal_comma_csv",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS data, count(*) AS n, round(sum(o_totalprice), 2) AS valor
    FROM orders GROUP BY 1""",
)
def decimal_comma_csv(spark, d):
    path = new_path(spark, "rates-csv")
    text = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("data"),
        F.translate(F.col("o_totalprice").cast("string"), ".", ",").alias("valor"),
    )
    text.write.option("sep", ";").option("header", True).csv(path)
    got = files.read_decimal_comma_rates(spark, path)
    return got.groupBy(F.col("data").cast("string").alias("data")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("valor"), 2).alias("valor")
    )


@query("A3_saved_index_csv", f"SELECT row_id, produto, venda FROM {t.PRICES_SQL}")
def saved_index_csv(spark, d):
    path = new_path(spark, "indexed-csv")
    rows = t.prices(spark, d).select(F.col("row_id").alias(""), "produto", "venda")
    files.write_table(rows, path, "csv")
    schema = T.StructType().add("produto", "string").add("venda", "double")
    return files.read_indexed_csv(spark, path, schema)


@query(
    "A4_parquet_scan",
    """SELECT l_orderkey, l_extendedprice, l_discount FROM lineitem
    WHERE l_quantity > 45 AND l_returnflag = 'R'""",
)
def parquet_scan(spark, d):
    rows = files.read_parquet(spark, f"{d.rstrip('/')}/lineitem.parquet")
    return rows.filter("l_quantity > 45 AND l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount")


@query("A5_overwrite_sink", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def overwrite_sink(spark, d):
    path = new_path(spark, "sink")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    files.write_table(rows.filter("c_custkey < 10"), path)
    files.write_table(rows, path)
    return spark.read.parquet(path)


@query("A6_write_if_absent", "SELECT s_suppkey, s_name FROM supplier")
def write_if_absent(spark, d):
    path = new_path(spark, "stage")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")
    files.write_once(rows, path)
    files.write_once(rows.filter("s_suppkey < 0"), path)  # ignored: the stage exists
    return spark.read.parquet(path)


@query(
    "A7_scene_selection",
    f"""SELECT scene_id, round(cloud_cover, 6) AS cloud_cover FROM {t.SCENES_SQL}
    WHERE max_lon >= -74.01 AND min_lon <= -73.86 AND max_lat >= 40.75 AND min_lat <= 40.88
    AND time BETWEEN TIMESTAMP '1997-06-01 00:00:00' AND TIMESTAMP '1999-09-01 00:00:00' AND cloud_cover < 30""",
)
def scene_selection(spark, d):
    got = tiles.select_scenes(t.scenes(spark, d), (-74.01, 40.75, -73.86, 40.88), "1997-06-01 00:00:00", "1999-09-01 00:00:00")
    return got.select("scene_id", r("cloud_cover").alias("cloud_cover"))


# embeddings as 8x8 single-band tiles laid out 25 to a row
TILE_LAT0, TILE_LON0 = 40.88, -74.01
TILES_SQL = f"""(SELECT vec_id, (i - 1) // 8 AS row, (i - 1) % 8 AS col,
    {TILE_LAT0} - (vec_id // 25) * 8 * (10.0 / 111320) - ((i - 1) // 8) * (10.0 / 111320) AS latitude,
    {TILE_LON0} + (vec_id % 25) * 8 * (10.0 / 111320) + ((i - 1) % 8) * (10.0 / 111320) AS longitude,
    CAST(embedding[i] AS DOUBLE) AS band
    FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""


def tile_pixels(spark, d):
    step = F.lit(8 * tiles.DEGREES_PER_PIXEL)
    lat0 = F.lit(TILE_LAT0) - F.floor(F.col("vec_id") / 25) * step
    lon0 = F.lit(TILE_LON0) + (F.col("vec_id") % 25) * step
    source = table(spark, d, "embeddings").withColumnRenamed("embedding", "band")
    rows = tiles.explode_tiles(source, ["band"], lat0, lon0, 8, keep=["vec_id"])
    return rows.withColumn("band", F.col("band").cast("double"))


@query(
    "A8_tile_explode",
    f"""SELECT vec_id, row, col, round(latitude, 8) AS latitude, round(longitude, 8) AS longitude,
    round(band, 6) AS band FROM {TILES_SQL}""",
)
def tile_explode(spark, d):
    return tile_pixels(spark, d).select(
        "vec_id", "row", "col", r("latitude", 8).alias("latitude"), r("longitude", 8).alias("longitude"), r("band").alias("band")
    )


@query(
    "A9_pixel_scale",
    """SELECT row, round(max(latitude) - min(latitude), 9) AS height FROM (SELECT vec_id // 25 AS row,
    (vec_id // 25) * 8 * (10.0 / 111320) + ((i - 1) // 8) * (10.0 / 111320) AS latitude
    FROM (SELECT vec_id, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY row""",
)
def pixel_scale(spark, d):
    rows = tile_pixels(spark, d).withColumn("row", F.floor(F.col("vec_id") / 25))
    return rows.groupBy("row").agg(r(F.max("latitude") - F.min("latitude"), 9).alias("height"))


@query(
    "A10_result_table_sink",
    """SELECT o_orderpriority AS model, count(DISTINCT o_orderstatus) AS num_features,
    min(o_orderstatus) AS first_feature, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY 1""",
)
def result_table_sink(spark, d):
    path = new_path(spark, "report")
    report = (
        table(spark, d, "orders")
        .groupBy(F.col("o_orderpriority").alias("model"))
        .agg(
            F.sort_array(F.collect_set("o_orderstatus")).alias("features"),
            F.create_map(F.lit("score"), F.avg("o_totalprice")).alias("params"),
        )
    )
    files.write_table(report, path)
    back = spark.read.parquet(path)
    return back.select(
        "model",
        F.size("features").cast("bigint").alias("num_features"),
        F.element_at("features", 1).alias("first_feature"),
        r(F.element_at("params", "score"), 4).alias("score"),
    )


@query(
    "A11_model_save_load",
    """SELECT p_partkey, round((SELECT regr_intercept(p_retailprice, p_size) FROM part)
    + (SELECT regr_slope(p_retailprice, p_size) FROM part) * p_size, 4) AS prediction FROM part""",
)
def model_save_load(spark, d):
    path = new_path(spark, "model")
    rows = table(spark, d, "part")
    stages = [
        VectorAssembler(inputCols=["p_size"], outputCol="x"),
        LinearRegression(featuresCol="x", labelCol="p_retailprice", solver="normal"),
    ]
    save_model(Pipeline(stages=stages).fit(rows), path)
    return load_model(path).transform(rows).select("p_partkey", r("prediction", 4).alias("prediction"))


@query("A12_submission_sink", f'SELECT px AS "Longitude", py AS "Latitude", round(target, 6) AS "UHI Index" FROM {t.POINTS_SQL}')
def submission_sink(spark, d):
    path = new_path(spark, "submission")
    rows = submission(t.points(spark, d).withColumn("prediction", r("target")), "px", "py")
    files.write_table(rows, path, "csv")
    return files.read_csv(spark, path, "Longitude double, Latitude double, `UHI Index` double")


@query("B1_rename", "SELECT s_suppkey AS id, s_acctbal AS longitude, s_nationkey AS latitude FROM supplier")
def rename(spark, d):
    names = {"s_suppkey": "id", "s_acctbal": "longitude", "s_nationkey": "latitude"}
    return table(spark, d, "supplier").withColumnsRenamed(names).select(*names.values())


@query("B2_drop_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def drop_columns(spark, d):
    return table(spark, d, "customer").drop("c_name", "c_mktsegment", "spatial_ref")


@query("B3_subset_reorder", "SELECT p_retailprice, p_size, p_partkey FROM part")
def subset_reorder(spark, d):
    return table(spark, d, "part").select("p_retailprice", "p_size", "p_partkey")


@query(
    "B4_first_of_duplicate_names",
    """SELECT c_custkey AS id, c_acctbal AS balance, s_name AS name
    FROM customer JOIN supplier ON c_custkey = s_suppkey""",
)
def first_of_duplicates(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    right = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")
    )
    return rel.side_by_side(left, right, "id").filter("balance IS NOT NULL AND name IS NOT NULL")


@query(
    "B5_within_time_range",
    """SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN
    (SELECT min(CAST(l_shipdate AS TIMESTAMP)) FROM lineitem WHERE l_discount > 0.05 AND l_quantity > 49 AND l_tax > 0.07)
    AND (SELECT max(CAST(l_shipdate AS TIMESTAMP)) FROM lineitem WHERE l_discount > 0.05 AND l_quantity > 49 AND l_tax > 0.07)""",
)
def time_range(spark, d):
    other = table(spark, d, "lineitem").filter("l_discount > 0.05 AND l_quantity > 49 AND l_tax > 0.07")
    other = other.select(F.col("l_shipdate").cast("timestamp_ntz").alias("time"))
    orders = table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp_ntz"))
    return rel.within_time_range(orders, "at", other, "time").select("o_orderkey")


@query("B6_equality_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def equality_filter(spark, d):
    rows = table(spark, d, "orders")
    return rows.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).select(
        "o_orderkey", "o_totalprice"
    )


@query("B7_lower_date_bound", f"SELECT row_id, CAST(data AS VARCHAR) AS data FROM {t.PRICES_SQL} WHERE data >= DATE '1999-01-06'")
def lower_date_bound(spark, d):
    rows = rel.after_day(t.prices(spark, d), "data", "1999-01-06")
    return rows.select("row_id", F.col("data").cast("string").alias("data"))


NEAREST_SQL = f"""(SELECT p.point_id, arg_min(q.pixel_id, (sqrt(power(x - px, 2) + power(y - py, 2)), pixel_id)) AS pixel_id,
    min(sqrt(power(x - px, 2) + power(y - py, 2))) AS distance
    FROM {t.POINTS_SQL} p, {t.PIXELS_SQL} q GROUP BY p.point_id)"""


def nearest(spark, d):
    return nearest_join(t.points(spark, d), t.pixels(spark, d), "point_id", "pixel_id", ("px", "py"), ("x", "y"))


@query(
    "B8_radius_counts",
    f"""SELECT count(*) FILTER (distance < 1) AS within_1, count(*) FILTER (distance < 3) AS within_3,
    count(*) FILTER (distance < 10) AS within_10 FROM {NEAREST_SQL}""",
)
def radius_counts(spark, d):
    return rel.radius_counts(nearest(spark, d), "distance", [1, 3, 10])


RATIO_SQL = f"""(SELECT month_end, avg(venda) FILTER (produto = '1-URGENT') AS top, avg(venda) FILTER (produto = '5-LOW') AS bottom
    FROM (SELECT *, last_day(data) AS month_end FROM {t.PRICES_SQL}) GROUP BY month_end)"""


@query(
    "B9_ratio_band_share",
    f"""SELECT round(100.0 * avg(CASE WHEN top / NULLIF(bottom, 0) * 100 BETWEEN 90 AND 110 THEN 1 ELSE 0 END), 6) AS share
    FROM {RATIO_SQL}""",
)
def ratio_band_share(spark, d):
    from terralag.operators.series import pivot_ratio

    rows = t.prices(spark, d).withColumn("month_end", s.month_end(F.col("data")))
    ratio = pivot_ratio(rows, "month_end", "produto", "venda", "1-URGENT", "5-LOW", t.PRODUCTS)
    return ratio.agg(r(s.in_band_percent(F.col("ratio_percent"), 90.0, 110.0)).alias("share"))


@query(
    "B10_date_split",
    f"""SELECT produto, CASE WHEN data <= DATE '1999-05-31' THEN 'train' ELSE 'test' END AS part, count(*) AS n
    FROM {t.PRICES_SQL} WHERE data <= DATE '1999-05-31' OR data BETWEEN DATE '1999-06-01' AND DATE '2001-05-31' GROUP BY 1, 2""",
)
def date_split(spark, d):
    train, test = rel.split_by_date(t.prices(spark, d), "data", "1999-05-31", "1999-06-01", "2001-05-31")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("produto", "part").agg(F.count(F.lit(1)).alias("n"))


@query("B11_numeric_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def numeric_only(spark, d):
    rows = table(spark, d, "part")
    return rows.select(*numeric_columns(rows))


@query(
    "B12_drop_sparse_columns",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS some FROM customer""",
)
def sparse_columns(spark, d):
    rows = table(spark, d, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS some",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS many",
    )
    return rel.drop_sparse_columns(rows, 0.2)


@query(
    "B13_drop_missing",
    f"""SELECT 'any' AS mode, count(*) AS n FROM {t.FRAME_SQL} WHERE qty IS NOT NULL AND price IS NOT NULL AND disc IS NOT NULL
    AND tax IS NOT NULL UNION ALL SELECT 'subset', count(*) FROM {t.FRAME_SQL} WHERE qty IS NOT NULL""",
)
def drop_missing(spark, d):
    rows = t.frame(spark, d)
    n = F.count(F.lit(1)).alias("n")
    return (
        rows.dropna().agg(n).select(F.lit("any").alias("mode"), "n")
        .unionByName(rows.dropna(subset=["qty"]).agg(n).select(F.lit("subset").alias("mode"), "n"))
    )


@query("B14_fill_zero", f"SELECT okey, coalesce(qty, 0) AS qty, coalesce(tax, 0) AS tax FROM {t.FRAME_SQL}")
def fill_zero(spark, d):
    return rel.fill_zero(t.frame(spark, d), ["qty", "tax"]).select("okey", "qty", "tax")


@query(
    "B15_conditional_label",
    "SELECT c_custkey, CASE WHEN c_acctbal / 10000 >= 0.7 THEN 'good' ELSE 'poor' END AS label FROM customer",
)
def conditional_label(spark, d):
    return table(spark, d, "customer").select("c_custkey", s.label_score(F.col("c_acctbal") / 10000).alias("label"))


# ---- joins

FX_SQL = f"""(SELECT CAST(date_trunc('month', data) + INTERVAL 1 MONTH AS DATE) AS month, avg(valor) AS dol_val
    FROM {t.RATES_SQL} GROUP BY 1)"""


def fx_monthly(spark, d):
    from terralag.operators.series import monthly_mean, move_to_next_month

    monthly = monthly_mean(t.rates(spark, d), "data", ["valor"])
    return move_to_next_month(monthly, "month_end", "month").select("month", F.col("valor").alias("dol_val"))


MONTHS_AT_MOST = 50_000


def priced_with_fx(spark, d):
    from terralag.session import cut_lineage

    rows = t.prices(spark, d).withColumn("month", F.trunc("data", "month"))
    # the calendar bounds the rates; the count proves it before they are sent out, so prices are never shuffled
    monthly = cut_lineage(fx_monthly(spark, d))
    return rows.join(F.broadcast(monthly) if monthly.count() <= MONTHS_AT_MOST else monthly, "month", "left")


@query(
    "C1_rate_join",
    f"""SELECT p.row_id, round(f.dol_val, 6) AS dol_val FROM {t.PRICES_SQL} p
    LEFT JOIN {FX_SQL} f ON f.month = CAST(date_trunc('month', p.data) AS DATE)""",
)
def rate_join(spark, d):
    return priced_with_fx(spark, d).select("row_id", r("dol_val").alias("dol_val"))


@query(
    "C3_suffix_join",
    """SELECT c_custkey AS id, c_acctbal AS balance_x, s_acctbal AS balance_y FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
)
def suffix_join(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return rel.suffix_join(left, right, "id")


@query(
    "C4_side_by_side",
    """SELECT coalesce(c_custkey, p_partkey) AS id, c_acctbal, p_retailprice FROM customer FULL JOIN part ON c_custkey = p_partkey""",
)
def side_by_side(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    right = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    return rel.side_by_side(left, right, "id")


@query("C5_nearest_pixel", f"SELECT point_id, pixel_id, round(distance, 6) AS distance FROM {NEAREST_SQL}")
def nearest_pixel(spark, d):
    return nearest(spark, d).select("point_id", "pixel_id", r("distance").alias("distance"))


@query(
    "C6_label_pixels",
    f"""SELECT q.pixel_id, arg_min(p.point_id, (sqrt(power(x - px, 2) + power(y - py, 2)), point_id)) AS point_id,
    round(min(sqrt(power(x - px, 2) + power(y - py, 2))), 6) AS distance
    FROM {t.POINTS_SQL} p, {t.PIXELS_SQL} q GROUP BY q.pixel_id""",
)
def label_pixels(spark, d):
    got = nearest_join(t.pixels(spark, d), t.points(spark, d), "pixel_id", "point_id", ("x", "y"), ("px", "py"))
    return got.select("pixel_id", "point_id", r("distance").alias("distance"))


SENSORS_SQL = """(SELECT user_id AS sensor_id, avg(value) AS airtemp, min(user_id) * 67.0 - 500 AS x,
    CAST(user_id % 25 AS DOUBLE) AS y FROM events GROUP BY user_id)"""


@query(
    "C7_nearest_sensor_mean",
    f"""SELECT point_id, arg_min(sensor_id, (sqrt(power(x - px, 2) + power(y - py, 2)), sensor_id)) AS sensor_id,
    round(arg_min(airtemp, (sqrt(power(x - px, 2) + power(y - py, 2)), sensor_id)), 6) AS airtemp
    FROM {t.POINTS_SQL}, {SENSORS_SQL} GROUP BY point_id""",
)
def nearest_sensor_mean(spark, d):
    sensors = (
        table(spark, d, "events")
        .groupBy(F.col("user_id").alias("sensor_id"))
        .agg(F.avg("value").alias("airtemp"))
        .withColumns({"x": F.col("sensor_id") * 67.0 - 500, "y": (F.col("sensor_id") % 25).cast("double")})
    )
    got = nearest_join(t.points(spark, d), sensors, "point_id", "sensor_id", ("px", "py"), ("x", "y"))
    return got.select("point_id", "sensor_id", r("airtemp").alias("airtemp"))


# probe points spread over (and a little beyond) the tile raster
PROBE_LAT = f"{TILE_LAT0} - (s_suppkey * 7919 % 1000) / 1000.0 * 0.016"
PROBE_LON = f"{TILE_LON0} + (s_suppkey * 104729 % 1000) / 1000.0 * 0.019"


@query(
    "C8_grid_snap_join",
    f"""SELECT s_suppkey AS point_id,
    arg_min(pixel_id, (round(sqrt(power(latitude - lat, 2) + power(longitude - lon, 2)), 12), pixel_id)) AS pixel_id,
    round(min(sqrt(power(latitude - lat, 2) + power(longitude - lon, 2))), 9) AS distance
    FROM (SELECT s_suppkey, {PROBE_LAT} AS lat, {PROBE_LON} AS lon FROM supplier),
    (SELECT vec_id * 64 + row * 8 + col AS pixel_id, latitude, longitude FROM {TILES_SQL}) GROUP BY s_suppkey""",
)
def grid_snap(spark, d):
    from terralag.operators.nearest import grid_snap_join

    probes = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("point_id"), F.expr(PROBE_LAT).alias("lat"), F.expr(PROBE_LON).alias("lon")
    )
    raster = tile_pixels(spark, d).select(
        (F.col("vec_id") * 64 + F.col("row") * 8 + F.col("col")).alias("pixel_id"),
        (F.floor(F.col("vec_id") / 25) * 8 + F.col("row")).alias("row"),
        (F.col("vec_id") % 25 * 8 + F.col("col")).alias("col"),
        "latitude",
        "longitude",
    )
    got = grid_snap_join(
        probes, raster, "point_id", "pixel_id", ("lat", "lon"), ("latitude", "longitude"),
        TILE_LAT0, TILE_LON0, tiles.DEGREES_PER_PIXEL,
    )
    return got.select("point_id", "pixel_id", r("distance", 9).alias("distance"))


@query("C9_degrees_to_metres", f"SELECT point_id, round(distance * 111320, 3) AS distance_meters FROM {NEAREST_SQL}")
def to_metres(spark, d):
    return nearest(spark, d).select("point_id", r(degrees_to_metres(F.col("distance")), 3).alias("distance_meters"))


@query(
    "C10_aligned_difference",
    """SELECT round(stddev_samp(a.o_totalprice - b.total), 4) AS total FROM orders a
    JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey""",
)
def aligned_difference(spark, d):
    from terralag.operators.scoring import prediction_difference

    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("total"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.sum("l_extendedprice").alias("total"))
    return prediction_difference(a, b, "row_id", ["total"]).agg(r(F.stddev_samp("total"), 4).alias("total"))


PANEL_SQL = f"""(SELECT produto, last_day(data) AS month_end, avg(venda) AS venda, avg(compra) AS compra
    FROM {t.PRICES_SQL} GROUP BY 1, 2)"""


@query(
    "C11_reindex_forward_fill",
    f"""SELECT produto, CAST(month_end AS VARCHAR) AS month_end,
    round(last_value(dol_val IGNORE NULLS) OVER (PARTITION BY produto ORDER BY month_end
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS dol_val
    FROM {PANEL_SQL} LEFT JOIN (SELECT last_day(month) AS month_end, dol_val FROM {FX_SQL} WHERE month(month) % 3 <> 0) USING (month_end)""",
)
def reindex_fill(spark, d):
    from terralag.operators.series import align_to, monthly_mean

    panel = monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    fx = fx_monthly(spark, d).filter(F.month("month") % 3 != 0).select(F.last_day("month").alias("month_end"), "dol_val")
    got = align_to(panel, fx, "produto", "month_end", "dol_val")
    return got.select("produto", F.col("month_end").cast("string").alias("month_end"), r("dol_val").alias("dol_val"))


@query(
    "C12_actual_vs_predicted",
    f"""SELECT a.produto, CAST(a.month_end AS VARCHAR) AS month_end, round(a.venda, 4) AS real, round(b.venda, 4) AS predicted
    FROM {PANEL_SQL} a JOIN (SELECT produto, last_day(month_end + INTERVAL 20 DAY) AS month_end, venda FROM {PANEL_SQL}) b
    USING (produto, month_end)""",
)
def actual_vs_predicted(spark, d):
    from terralag.operators.series import monthly_mean

    panel = monthly_mean(t.prices(spark, d), "data", ["venda"], ["produto"])
    moved = panel.select(
        "produto", F.last_day(F.date_add("month_end", 20)).alias("month_end"), F.col("venda").alias("predicted")
    )
    return panel.join(moved, ["produto", "month_end"]).select(
        "produto", F.col("month_end").cast("string").alias("month_end"), r("venda", 4).alias("real"), r("predicted", 4).alias("predicted")
    )


@query(
    "C13_parameter_product",
    f"""SELECT produto, p, d, q FROM (SELECT DISTINCT produto FROM {t.PRICES_SQL}), range(0, 3) a(p), range(0, 3) b(d), range(0, 3) c(q)""",
)
def parameter_product(spark, d):
    keys = t.prices(spark, d).select("produto").distinct()
    return rel.parameter_grid(keys, p=range(3), d=range(3), q=range(3)).select("produto", *[F.col(c).cast("bigint").alias(c) for c in "pdq"])


# ---- sort, limit, top-k, union


@query("F1_sort", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def sort_rows(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.col("s_acctbal").desc(), "s_suppkey")


@query("F2_smallest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 3")
def smallest_rows(spark, d):
    from terralag.operators.selection import smallest

    return smallest(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 3, "c_custkey")


@query(
    "F3_best_row",
    """SELECT o_orderpriority, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, min(o_totalprice) AS o_totalprice
    FROM orders GROUP BY 1""",
)
def best_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return rel.best_row(rows, "o_totalprice", "o_orderkey", ["o_orderpriority"])


@query("F4_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def head(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(5)


@query(
    "F5_row_concat",
    "SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer",
)
def row_concat(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id"))
    return a.unionByName(b)
