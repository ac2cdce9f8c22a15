"""Cutting the lineage of iterations, and tables made on the way: kept in the shared folder, never on one machine."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. A local session without that
    setting gets a folder of its own; on a cluster that is an error, as executors would each write to
    their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(removed, spark, found)
    return found


def removed(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: a lost executor costs a re-read."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
