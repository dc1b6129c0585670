"""Sessions, and shipping this package to Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sourceloom.plans.staging import COMPRESSION

#: Partitions of a shuffle before small ones are put together, and compressed bytes up to which they are.
PARTITIONS, TASK_BYTES = 200, "8m"
#: Rows (of what files are made from) for which there is a partition, where they are more than that.
PARTITION_ROWS = 2000
#: Compressed bytes of files that a task reads; a small file counts as 4 MB.
READ_BYTES = 16 << 20
_LEAST = "sourceloom.partitions"
#: Letters of a plan's description: it is made anew whenever a part of the plan has been measured.
DESCRIPTION = 10_000

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once per application, let the workers import this package, wherever it is installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "sourceloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*")):
            if f.suffix in (".py", ".yaml"):
                z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound Arrow batches by bytes, as rows may be very long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= size:
        spark.conf.set(key, str(size))


def partitions(rows: DataFrame) -> int:
    """How many partitions the rows of a table ask for, so that a task's share doesn't grow with them."""
    return -(-rows.count() // PARTITION_ROWS)


def _bytes(size: str) -> int:
    """Bytes of a setting like 16m or 128MB."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def measured_session(spark: SparkSession, least: int = 1) -> SparkSession:
    """A session beside ``spark``, with its settings, that tells the sizes of joins and tasks from measured data.

    Files tell their compressed size, which for tables of code is a small part of what
    the driver holds when it broadcasts them.  Here only a side that has been shuffled,
    and so measured, is broadcast; and tasks get as many partitions (``least`` or more)
    and as little compressed data that sorts of them stay small.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    measured = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    own.conf.set(measured, spark.conf.get(measured, None) or spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(PARTITIONS, least, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    own.conf.set("spark.sql.unionOutputPartitioning", "false")  # parts of a union that are put together anew need not be as many
    own.conf.set("spark.sql.parquet.compression.codec", COMPRESSION)
    own.conf.set(_LEAST, str(least))
    if _bytes(own.conf.get("spark.sql.files.maxPartitionBytes")) > READ_BYTES:
        own.conf.set("spark.sql.files.maxPartitionBytes", str(READ_BYTES))
    own.conf.set("spark.sql.maxPlanStringLength", str(DESCRIPTION))
    return own


def compile_in_tasks(spark: SparkSession) -> None:
    """For sessions of many plans: leave the compiling to the executors, as the driver would keep classes of every stage of every plan."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows from which much is made, in as many partitions as their session asks for, and more than there are cores: a file's row groups may be few."""
    spark = rows.sparkSession
    least = max(int(spark.conf.get(key, "1")) for key in (_LEAST, "spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, 4 * spark.sparkContext.defaultParallelism), *keys)


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, as tests and the bench use it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sourceloom")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
