"""Batch scoring of points and comparison of two prediction sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from terralag.functions.indices import with_indices
from terralag.operators.nearest import degrees_to_metres, nearest_join


def point_features(
    points: DataFrame,
    pixels: DataFrame,
    point_id: str,
    pixel_id: str,
    point_xy: tuple[str, str],
    pixel_xy: tuple[str, str],
    indices: Sequence[str],
) -> DataFrame:
    """Points with their nearest pixel's bands, distance in degrees and metres, and indices.

    Indices are computed after the join: on the matched rows only.
    """
    joined = nearest_join(points, pixels, point_id, pixel_id, point_xy, pixel_xy)
    return with_indices(joined.withColumn("distance_meters", degrees_to_metres(F.col("distance"))), indices)


def submission(scored: DataFrame, lon: str, lat: str, prediction: str = "prediction", target: str = "UHI Index"):
    """Fixed column order: Longitude, Latitude, target."""
    return scored.select(
        F.col(lon).alias("Longitude"), F.col(lat).alias("Latitude"), F.col(prediction).alias(target)
    )


def prediction_difference(a: DataFrame, b: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """``(row_id, <column>..)``: first minus second, rows aligned by ``row_id``."""
    right = b.select(row_id, *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = a.join(right, row_id)
    return joined.select(row_id, *[(F.col(c) - F.col(f"_b_{c}")).alias(c) for c in columns])
