"""Intermediate tables that survive lost executors: Parquet in the shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.errors import need
from ..session import ship


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a folder of this machine, for a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if given := spark.sparkContext.getCheckpointDir():
        return given.rstrip("/")
    need(spark.sparkContext.master.startswith("local"), "SHARED_FOLDER_UNSET")
    return f"file://{tempfile.gettempdir()}/threadloom-checkpoints"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/threadloom/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended
        pass


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read from there: no lineage, only the columns asked for are read again."""
    spark = df.sparkSession
    ship(spark)
    path = new_folder(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a stored table that no plan reads any more."""
    remove(df.sparkSession, df.stored_at)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
