"""Binary files through Spark's own writers and readers.

A file is written by the text source, which puts the bytes of a string column
into the file as they are; each row is followed by a separator that the file
format must allow there.  So files reach any store that Spark reaches, and a
task that is run again replaces its own file only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import stage_path


def write_raw(blocks: DataFrame, name: str, separator: str, path: str | None = None) -> str:
    """Write the only, binary column of ``blocks``, one file per partition; the folder's path."""
    path = path or stage_path(blocks.sparkSession, name)
    column = blocks.columns[0]
    blocks.select(F.col(column).cast("string").alias("value")).write.option("lineSep", separator).option("compression", "none").text(path)
    return path


def read_raw(spark: SparkSession, path: str, *, file: str | None = None) -> DataFrame:
    """content of every file of a folder that write_raw made; its path as the column ``file`` if asked."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return rows.select("content", *([F.col("path").alias(file)] if file else []))
