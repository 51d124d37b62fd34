"""File sources with explicit schemas, and sinks."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

from terralag.functions.scalars import decimal_comma, parse_day
from terralag.schemas import FX_TEXT, normalise


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", **options) -> DataFrame:
    """CSV with a header row; NaN and infinities become NULL."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep)
    return normalise(reader.options(**options).csv(path))


def read_decimal_comma_rates(spark: SparkSession, path: str) -> DataFrame:
    """``data;valor`` text with ``dd/MM/yyyy`` days and decimal commas to ``(data date, valor double)``."""
    text = read_csv(spark, path, FX_TEXT, sep=";")
    return text.select(parse_day(F.col("data")).alias("data"), decimal_comma(F.col("valor")).alias("valor"))


def read_indexed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV whose first, unnamed column is a saved row index; it becomes ``row_id``, the order key."""
    full = StructType().add("row_id", LongType())
    for field in schema.fields:
        full = full.add(field)
    # the header of the index column is empty, so names come from the schema, not from the file
    return read_csv(spark, path, full, enforceSchema=True)


def read_parquet(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """Parquet table. Tables this package writes hold no NaN; ``clean`` turns NaN of foreign files to
    NULL, at the price that filters on floating-point columns no longer reach the scan."""
    df = spark.read.parquet(path)
    return normalise(df) if clean else df


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Write a stage or result table. Arrays and maps need Parquet."""
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def _at(spark: SparkSession, path: str):
    """The Hadoop path and its file system: any store that Spark reads."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(df: DataFrame, version: str = "") -> str:
    """A digest of the files ``df`` reads (path, length, time of change), its schema and ``version``."""
    lines = [version, df.schema.simpleString()]
    for name in sorted(df.inputFiles()):
        path, fs = _at(df.sparkSession, name)
        status = fs.getFileStatus(path)
        lines.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _marker(spark: SparkSession, path: str) -> str | None:
    """The fingerprint that a finished write left, if there is one."""
    there, fs = _at(spark, f"{path.rstrip('/')}.committed")
    if not fs.exists(there):
        return None
    stream = fs.open(there)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_once(df: DataFrame, path: str, kind: str = "parquet", version: str = "") -> bool:
    """Write unless a complete stage made from the same inputs is there: a stage cache. Tells whether it wrote.

    The table is written aside and renamed, and a marker beside it, with the fingerprint of its inputs, is written last and
    removed first. So a stage that a lost job left half written, or whose inputs, schema or ``version`` have changed since, is
    made again; ``version`` names what the inputs do not show, such as the rules of the step.
    """
    spark, wanted = df.sparkSession, fingerprint(df, version)
    there, fs = _at(spark, path)
    if fs.exists(there) and _marker(spark, path) == wanted:
        return False
    marker, _ = _at(spark, f"{path.rstrip('/')}.committed")
    fs.delete(marker, False)
    aside, _ = _at(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    write_table(df, aside.toString(), kind)
    fs.delete(there, True)
    if not fs.rename(aside, there):
        raise OSError(f"cannot rename the stage to {path}")
    stream = fs.create(marker, True)
    try:
        stream.write(wanted.encode())
    finally:
        stream.close()
    return True
