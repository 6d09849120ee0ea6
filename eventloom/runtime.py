"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors must share. Where it is unset, a local master (tests) gets an own folder; on a cluster that is an error."""
    sc = spark.sparkContext
    if not (path := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later reads survive a lost executor and start from there. Its shuffle files go once it is written."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return _with_plain_size(df.select("*").checkpoint(eager=True))
    finally:
        spark.conf.set(_CLEANUP, before)


#: Bits of a size estimate from which on it is dropped.
_MOST_BITS = 1024


def _with_plain_size(stored: DataFrame) -> DataFrame:
    """stored, without an estimate of its size that has outgrown _MOST_BITS.

    A stored result keeps the estimate of its plan, and a join's is the product of its sides': over stored results of joins of stored results the
    estimates' digits double from step to step, until planning does nothing but multiply them. Without one, the size is unknown until the rows are read.
    """
    plan = stored._jdf.queryExecution().analyzed()
    try:
        if int(plan.stats().sizeInBytes()).bit_length() <= _MOST_BITS:
            return stored
    except ValueError:  # more digits than Python reads
        pass
    session = stored.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(plan.rdd(), stored._jdf.schema(), False), session)


def drop(*frames: DataFrame) -> None:
    """Delete what cut() stored for frames that nothing needs any more."""
    for df in frames:
        stored = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if stored.isDefined():
            remove(df.sparkSession, stored.get())
