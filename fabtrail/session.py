"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: rows of a file, about, where many small partitions are stored in few files
FILE_ROWS = 1 << 17

#: the same where rows are stored as they are computed: a file's rows are one task's work
TASK_ROWS = 1 << 14


def build_session(app_name: str = "fabtrail", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library is tuned for; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # dates and file names used as partition values must come back as strings
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        # a replaced file rewrites its own partition only
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    A session on one machine that names none (as in tests) gets a folder that goes when the
    process ends; a session on a cluster must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = _local_folder()
    return configured.rstrip("/")


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="fabtrail-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, in the application's own part of it."""
    return f"{_own_scratch(spark)}/{tag}-{uuid.uuid4().hex}"


def _own_scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fabtrail/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this application has stored on the way, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Needed wherever a row's place in a range-partitioned order is used more than once:
    a lost executor then re-reads the stored rows instead of recomputing other places.
    Being columnar, later reads take only the columns they need.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_few(df: DataFrame, tag: str, most: int | None = None) -> DataFrame:
    """``stored``, for few rows left in many partitions: of about ``FILE_ROWS`` rows a file, or as many files as cores.

    Each file costs the task that writes it requests to the file system, on a local one even processes of their own. ``most`` is a
    bound on the rows; where one is known, they need not be kept and counted first, and a file gets ``TASK_ROWS`` of it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if most is not None:
        return stored(df.coalesce(max(cores, -(-most // TASK_ROWS))), tag)
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        files = max(cores, -(-kept.count() // FILE_ROWS))
        return stored(kept.coalesce(files), tag)
    finally:
        kept.unpersist()


def barrier(df: DataFrame) -> DataFrame:
    """Keep later filters above the projections of ``df``.

    A filter on a parsed column would be pushed below the projections that derive it: the
    parsing would run twice, and the expression would multiply with every stage it passes.
    The condition always holds.
    """
    return df.where(F.monotonically_increasing_id() >= 0)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy work on rows that come from few small files.

    A frame that has at least half as many partitions as there are cores is left as it is, so
    large inputs are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def conformed(df: DataFrame, schema: T.StructType) -> list[Column]:
    """The columns of a schema; missing ones are null.

    A column that has its type already is taken as it is: a cast to the same type would make
    an alias, and the optimizer carries every known fact over to every alias.
    """
    have = {f.name: f.dataType for f in df.schema}
    return [
        F.col(f.name)
        if have.get(f.name) == f.dataType
        else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
