"""Reproducible splits: a row's bucket depends on its key and the seed only, not on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    """First 8 hex digits of ``md5(key|seed)``, modulo ``buckets``."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def train_test_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``part``: ``test`` for about ``test_share`` of the keys, else ``train``."""
    test = hash_bucket(F.col(key), seed, 1000) < round(test_share * 1000)
    return df.withColumn("part", F.when(test, "test").otherwise("train"))


def k_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in ``0..k-1``."""
    return df.withColumn("fold", hash_bucket(F.col(key), seed, k).cast("int"))
