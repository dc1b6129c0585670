"""Intermediate tables in the cluster's shared folder.

A stage table is written once under the folder named by ``spark.checkpoint.dir``
and read back: later steps don't compute it again, and a lost executor only
costs the tasks that were running on it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Of the graph's and the store's files: ids are hex digits, of which it keeps half the bytes.
COMPRESSION = "zstd"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this cluster; one of our own only where none is set and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/stage-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """With these settings (dots are written as ``__``), and then those before."""
    values = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def without_shuffle_files(spark: SparkSession):
    """What is written within it leaves no shuffle files, which are of no use once it is written."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    with without_shuffle_files(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stage_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._stage_path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
