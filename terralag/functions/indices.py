"""Spectral indices as Column functions.

Bands are cast to double first, so unsigned band types cannot wrap around. A zero denominator
gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values of the index definitions
EPS = 1e-6
SOIL_L = 0.5


def _band(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def normalised_difference(a: str | Column, b: str | Column, eps: float = EPS) -> Column:
    a, b = _band(a), _band(b)
    return F.try_divide(a - b, a + b + F.lit(eps))


def ndvi(b08="B08", b04="B04", eps: float = EPS) -> Column:
    return normalised_difference(b08, b04, eps)


def mndwi(b03="B03", b11="B11", eps: float = EPS) -> Column:
    return normalised_difference(b03, b11, eps)


def ndbi(b11="B11", b08="B08", eps: float = EPS) -> Column:
    return normalised_difference(b11, b08, eps)


def ndmi(b08="B08", b11="B11", eps: float = EPS) -> Column:
    return normalised_difference(b08, b11, eps)


def nbr(b08="B08", b12="B12", eps: float = EPS) -> Column:
    return normalised_difference(b08, b12, eps)


def savi(b08="B08", b04="B04", soil: float = SOIL_L, eps: float = EPS) -> Column:
    nir, red = _band(b08), _band(b04)
    return F.try_divide((nir - red) * F.lit(1 + soil), nir + red + F.lit(soil + eps))


def evi(b08="B08", b04="B04", b02="B02") -> Column:
    nir, red, blue = _band(b08), _band(b04), _band(b02)
    return F.try_divide(F.lit(2.5) * (nir - red), nir + 6 * red - F.lit(7.5) * blue + 1)


INDICES = {"NDVI": ndvi, "MNDWI": mndwi, "NDBI": ndbi, "SAVI": savi, "NDMI": ndmi, "NBR": nbr, "EVI": evi}


def with_indices(df: DataFrame, names=tuple(INDICES)) -> DataFrame:
    """Add the named indices. Call it after a nearest join, on the few matched rows."""
    return df.withColumns({name: INDICES[name]() for name in names})
