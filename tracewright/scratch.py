"""Tables and checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is named, one of its own on a local master, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewright-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, prefix: str = "table") -> str:
    return f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Write the rows as Parquet and read them again: computed once, pruned by column, and safe when executors go."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path, by which the driver reaches any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def removed(spark: SparkSession, folder: str) -> None:
    system, where = file_system(spark, folder)
    system.delete(where, True)
