"""Tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one machine gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loreweave-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def _of(spark: SparkSession, path: str):
    """The file system of a path, and the path, in the JVM."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/loreweave/{name}-{uuid.uuid4().hex}"
    fs, at = _of(spark, path)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Computes df once, writes it as a table in the shared folder and reads that: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def cut_together(**tables: DataFrame) -> list[DataFrame]:
    """cut of each table under its name, as jobs side by side."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return [x.result() for x in [pool.submit(cut, df, name) for name, df in tables.items()]]


def discard(df: DataFrame) -> None:
    """Deletes the table that cut wrote for df, once nothing is computed from it any more."""
    fs, at = _of(df.sparkSession, df._written)
    fs.delete(at, True)
