"""The missing-value rule.

There is one notion of missing: NULL. NaN and infinities become NULL when a table is read and
after every division, because Spark orders NaN above all numbers while SQL comparisons drop NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FX_TEXT = T.StructType([T.StructField("data", T.StringType()), T.StructField("valor", T.StringType())])


def finite(c: Column) -> Column:
    """``c`` as double, with NaN and infinities replaced by NULL."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def normalise(df: DataFrame) -> DataFrame:
    """Apply :func:`finite` to every float and double column."""
    cols = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({name: finite(F.col(name)) for name in cols}) if cols else df


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, in schema order."""
    kinds = (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
