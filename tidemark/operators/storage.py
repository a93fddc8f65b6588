"""Intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many narrow rows (a key or two) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 400_000
#: Drops a query's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; in local mode below a temporary one where that is unset.

    Spark deletes it when the application ends.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _application_folder(found or "", spark.sparkContext.applicationId)


@cache
def _application_folder(base: str, application: str) -> str:
    folder = f"{base.rstrip('/') or 'file://' + tempfile.mkdtemp(prefix='tidemark-')}/{application}"
    spark = SparkSession.getActiveSession()
    if spark is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df, written once as Parquet to the shared folder and read from there: a lost executor costs no recomputation.

    The shuffle files of the writing are dropped at its end, as the table is read from then on.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, splits: int = 1) -> DataFrame:
    """df dealt to all cores before heavy work if all of it fits into one split of a file and so would be one task; larger tables stay as they are read.

    Narrow rows of heavy work are worth dealing in larger tables too, up to so many splits.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= split * splits else df


def small_or_not(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint only if its counted rows are within the limit."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df
