"""Scene selection and raster tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

METRES_PER_PIXEL = 10
METRES_PER_DEGREE = 111_320
DEGREES_PER_PIXEL = METRES_PER_PIXEL / METRES_PER_DEGREE


def select_scenes(
    scenes: DataFrame, bbox: tuple[float, float, float, float], start: str, end: str, max_cloud: float = 30.0
) -> DataFrame:
    """Scenes that meet ``bbox`` (min lon, min lat, max lon, max lat) in the window, cloud below limit."""
    west, south, east, north = bbox
    return scenes.filter(
        (F.col("max_lon") >= west)
        & (F.col("min_lon") <= east)
        & (F.col("max_lat") >= south)
        & (F.col("min_lat") <= north)
        & F.col("time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
        & (F.col("cloud_cover") < max_cloud)
    )


def explode_tiles(
    tiles: DataFrame, bands: Sequence[str], lat0: Column, lon0: Column, width: int, res: float = DEGREES_PER_PIXEL, keep=()
) -> DataFrame:
    """One row per pixel: ``keep.., row, col, latitude, longitude, <bands>``.

    Bands are arrays in row-major order; ``latitude = lat0 - row*res``, ``longitude = lon0 + col*res``.
    A tile is a bounded block of pixels, so a row never expands without limit.
    """
    zipped = F.arrays_zip(*[F.col(b) for b in bands])
    rows = tiles.select(*keep, lat0.alias("_lat0"), lon0.alias("_lon0"), F.posexplode(zipped).alias("_pos", "_px"))
    return rows.select(
        *keep,
        F.floor(F.col("_pos") / width).cast("bigint").alias("row"),
        (F.col("_pos") % width).cast("bigint").alias("col"),
        (F.col("_lat0") - F.floor(F.col("_pos") / width) * F.lit(res)).alias("latitude"),
        (F.col("_lon0") + (F.col("_pos") % width) * F.lit(res)).alias("longitude"),
        *[F.col(f"_px.{b}").alias(b) for b in bands],
    )
