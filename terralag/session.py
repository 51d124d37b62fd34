"""Session construction and the shared scratch folder used for staged tables."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []
ROWS_PER_TASK = 50_000


def build_session(app: str = "terralag", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and UTC time; ``master`` is left to spark-submit unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder, since no other machine could read one.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="terralag-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> bool:
    """Delete one path of :func:`new_path`; nothing may read it any more."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if path in _staged:
        _staged.remove(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def drop_stages(spark: SparkSession) -> int:
    """Delete what :func:`new_path` gave out in this process; results that still read it must be written first."""
    return sum(drop_path(spark, path) for path in list(_staged))


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` over enough partitions for fits that keep their input, one cached part to a task.

    A large table may be one short compressed file, which would be one task. Up to two tasks' rows stay as they are. Rows are dealt
    and ordered by their values, so that draws by position are the same in every run.
    """
    n = df.count()
    if n <= 2 * rows_per_task:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = math.ceil(math.ceil(n / rows_per_task) / cores) * cores
    return df.repartition(parts).sortWithinPartitions(*df.columns)


def stage_columns(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as columns and read again, for tables that many scans read in part.

    A checkpoint keeps serialised rows, which each scan has to read whole.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
