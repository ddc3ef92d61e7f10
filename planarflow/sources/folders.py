"""Folders that driver and executors share, reached through Spark only."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder where that is unset and everything runs here, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="planarflow-"))
        known = sc._jsc.sc().getCheckpointDir()
    return str(known.get())


def new_folder(spark: SparkSession, label: str, stays: bool = False) -> str:
    """A name under the shared folder that no other call gives; deleted when the process ends, unless it stays."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not stays:
        atexit.register(_quietly, spark, path)
    return path


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a writer has ended there."""
    return exists(spark, f"{path}/_SUCCESS")


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has gone, and its folder with it
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: ends its lineage, survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
