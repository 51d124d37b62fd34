"""Rounds of the exact quantiles, and the partitions that fits get."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralag import session
from terralag.operators import quantiles, tuning
from terralag.operators.steps import Bagging


def test_later_rounds_read_only_the_rows_of_open_gaps(spark, monkeypatch):
    """The next round used to read the whole table, once for every gap that was still open."""
    rows = spark.range(30_000).select((F.pmod(F.xxhash64("id"), F.lit(10**6)) / 7).alias("x"))
    read, whole = [], quantiles._order_statistics

    def counting(df, *rest):
        read.append(df.count())
        return whole(df, *rest)

    monkeypatch.setattr(quantiles, "_order_statistics", counting)
    monkeypatch.setattr(quantiles, "_ACCURACY", 1000)  # wide gaps
    probs = [0.1, 0.5, 0.9]
    got = quantiles.exact_quantiles(rows, ["x"], probs, limit=50)["x"]
    assert got == pytest.approx(np.quantile([r.x for r in rows.collect()], probs))
    assert len(read) > 1 and read[0] == 30_000 and all(n < 10_000 for n in read[1:])


def test_a_sketch_that_is_off_costs_a_scan(spark, monkeypatch):
    """Ranks outside the gaps that a sketch points at are found all the same."""
    monkeypatch.setattr(quantiles, "PERCENTILE_LIMIT", 1000)
    rows = spark.range(4000).select((F.col("id") % 1237).cast("double").alias("x"))
    true = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, p, a: F.transform(true(c, p, a), lambda v: v / 2))
    probs = [0.0, 0.3, 0.95, 1.0]
    got = quantiles.exact_quantiles(rows, ["x"], probs, limit=2000)["x"]
    assert got == pytest.approx(np.quantile([r.x for r in rows.collect()], probs))


def test_one_file_is_spread_over_the_cores(spark):
    """A table of one partition used to be kept, and read again by every level of a tree, by one task."""
    rows = spark.range(0, 3000, 1, 1).withColumn("x", F.col("id") % 50)
    assert session.spread(rows, 2000).rdd.getNumPartitions() == 1
    wide = session.spread(rows, 300)
    sizes = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 10 and sum(sizes) == 3000 and max(sizes) < 600
    assert wide.rdd.getNumPartitions() % spark.sparkContext.defaultParallelism == 0


def test_a_search_spreads_its_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tuning, "spread", lambda df: seen.append(df.columns) or df)
    rows = spark.range(60).selectExpr("CAST(id AS DOUBLE) AS a", "id * 2.0 AS y", "CAST(id % 2 AS INT) AS fold")
    tuning.search(rows, tuning.grid("mean"), ["a"], "y", 2)
    assert seen == [["a", "fold", "y"]]


def test_members_of_a_bag_keep_their_order(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(400).selectExpr("id", "CAST(id % 20 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(id % 20 AS DOUBLE) AS y")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(rows)
    fits = [Bagging(5, 0.9, 1.0, 6, 3).setFeaturesCol("v").setLabelCol("y").fit(rows).transform(rows) for _ in range(2)]
    first, second = ([r.prediction for r in f.orderBy("id").select("prediction").collect()] for f in fits)
    assert first == second and np.abs(np.array(first) - [i % 20 for i in range(400)]).mean() < 0.5
