"""Files of a source tree, listed and read by the executors.

A tree is listed in rounds: the folders found in one round are expanded in the next,
each by the task that has it, so no task and not the driver holds the tree.  Links
aren't told by Spark's readers, so folders are looked into by the tasks; the tree must
be mounted where they run.  Only files whose path, size and link speak for them are
opened, and what can't be listed, looked at or read is a row with its error.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions import fixed
from sourceloom.functions.text import extension
from sourceloom.operators import discovery
from sourceloom.operators.discovery import PRINTABLE, printable_share
from sourceloom.plans.staging import stage_table
from sourceloom.session import bound_batches, ship_package
from sourceloom.sources import encodings

#: kind is file, folder, or error (of a folder that can't be listed).
LISTING = "kind string, rel_path string, link string, size long, error string"
_LISTED = pa.schema([("kind", pa.string()), ("rel_path", pa.string()), ("link", pa.string()), ("size", pa.int64()), ("error", pa.string())])
#: Entries of a folder that are sent on together.
ENTRIES = 4096


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _entry(top: str, entry: os.DirEntry, rel_path: str) -> tuple | None:
    """The row of one entry; none for a link to a folder, which isn't followed."""
    try:
        if entry.is_dir(follow_symlinks=False):
            return ("folder", rel_path, None, None, None)
        if not entry.is_symlink():
            return ("file", rel_path, None, entry.stat(follow_symlinks=False).st_size, None)
        real = os.path.realpath(entry.path)
        if os.path.isdir(real):
            return None
        link = "broken" if not os.path.exists(real) else "inside" if real.startswith(top + os.sep) else "outside"
        return ("file", rel_path, link, os.stat(real).st_size if link == "inside" else None, None)
    except OSError as e:
        return ("file", rel_path, "error", None, str(e))


def _expanded(top: str, lister: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's folders replaced by what is in them."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LISTED.types, strict=True)], schema=_LISTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch.column("rel_path").to_pylist():
                try:
                    with lister(os.path.join(top, folder)) as entries:
                        for entry in entries:
                            row = _entry(top, entry, f"{folder}/{entry.name}" if folder else entry.name)
                            rows += [row] if row else []
                            if len(rows) >= ENTRIES:
                                yield batch_of(rows)
                                rows = []
                except OSError as e:
                    rows.append(("error", folder, None, None, f"{type(e).__name__}: {e}"))
        if rows:
            yield batch_of(rows)

    return run


def list_tree(spark: SparkSession, root: str, lister: Callable = os.scandir) -> DataFrame:
    """(kind, rel_path, link, size, error) of everything below a folder, the folder itself too; links aren't followed.

    ``link`` is null, inside, broken, outside, or error for what can't be looked at.
    """
    if not os.path.isdir(root):
        raise ValueError(f"not a folder: {root}")
    ship_package(spark)
    top = os.path.realpath(root)
    frontier = found = spark.createDataFrame([("folder", "", None, None, None)], LISTING)
    while True:
        level = stage_table(frontier.select("rel_path").repartition("rel_path").mapInArrow(_expanded(top, lister), LISTING), "listing")
        found = found.union(level)
        frontier = level.filter("kind = 'folder'")
        if frontier.isEmpty():
            return found


def walk_anomalies(listing: DataFrame) -> DataFrame:
    """path, anomaly_type, severity, reason_detail of the folders of a listing that can't be read."""
    return listing.filter("kind = 'error'").select(F.col("rel_path").alias("path"), F.lit("PERMISSION_DENIED").alias("anomaly_type"), F.lit("ERROR").alias("severity"), F.col("error").alias("reason_detail"))


def scan_tree(spark: SparkSession, root: str, max_bytes: int = fixed.MAX_PARSE_BYTES, options: discovery.Options | None = None, listing: DataFrame | None = None, opener: Callable[[str], bytes] = read_bytes) -> DataFrame:
    """rel_path, abs_path, link, blob_sha256, text, size, read_error, error of the files of a tree.

    Not read are files over ``max_bytes``, links that lead out of the tree and, with
    ``options``, those that are passed over by their path or size; ``text`` is null for
    them and for binary content.  ``read_error`` marks files that should have been
    read and weren't, ``error`` says why.
    """
    listing = list_tree(spark, root) if listing is None else listing
    bound_batches(spark)
    top = os.path.realpath(root)
    path = F.concat(F.lit(top + os.sep), "rel_path")
    files = listing.filter("kind = 'file'").select("rel_path", path.alias("abs_path"), "link", "size", F.col("error").alias("look_error"))
    wanted = (F.col("link").isNull() | (F.col("link") == "inside")) & (F.col("size") <= max_bytes)
    if options is not None:
        wanted = wanted & F.coalesce(discovery.path_decision(F.col("rel_path"), F.col("size"), options).isNull(), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                row = batch.slice(k, 1)
                content = error = told = None
                if row.column("wanted")[0].as_py():
                    try:
                        content = opener(row.column("abs_path")[0].as_py())
                        name = encodings.detect(content)[0]
                        told = content.decode(name, "replace") if name in encodings.ENCODINGS and name != encodings.FALLBACK else None
                    except OSError as e:
                        error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([told], pa.string()), pa.array([error], pa.string())], [*row.schema.names, "content", "told", "open_error"])

    rows = files.withColumn("wanted", F.coalesce(wanted, F.lit(False))).repartition("rel_path")
    read = rows.mapInArrow(run, "rel_path string, abs_path string, link string, size long, look_error string, wanted boolean, content binary, told string, open_error string")
    text = F.when(~is_binary(F.col("rel_path"), F.col("content")), F.coalesce("told", decoded(F.col("content"))))
    return read.select("rel_path", "abs_path", "link", F.sha2("content", 256).alias("blob_sha256"), text.alias("text"), "size", F.col("open_error").isNotNull().alias("read_error"), F.coalesce("open_error", "look_error").alias("error"))


def read_anomalies(scanned: DataFrame) -> DataFrame:
    """path, anomaly_type, severity, reason_detail of files that couldn't be read."""
    return scanned.filter("read_error").select(F.col("rel_path").alias("path"), F.lit("READ_ERROR").alias("anomaly_type"), F.lit("ERROR").alias("severity"), F.concat(F.lit("Could not read: "), "error").alias("reason_detail"))


def is_binary(path, content):
    """By extension, by a leading signature, by a NUL outside UTF-16 and UTF-32, or by few printable bytes."""
    head = F.hex(F.substring(content, 1, 32768))
    wide = F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("FEFF")) | F.startswith(head, F.lit("0000FEFF"))
    signature = F.lit(False)
    for magic in ("7F454C46", "4D5A", "504B0304", "89504E47", "FFD8FF", "47494638", "25504446"):
        signature = signature | F.startswith(head, F.lit(magic))
    nul = head.rlike("^(?:..)*?00")
    by_content = F.when(nul, ~wide).otherwise(signature | (printable_share(content) < PRINTABLE))
    return extension(path).isin(*fixed.BINARY_EXTENSIONS) | F.coalesce(by_content, F.lit(False))


def decoded(content):
    """By byte order mark, else UTF-8 if it is valid, else Latin-1 (what ``encodings`` tells goes before that)."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(F.startswith(head, F.lit("EFBBBF")), F.decode(F.substr(content, F.lit(4)), "UTF-8"))
        .when(head.isin("FFFE0000", "0000FEFF"), F.decode(content, "UTF-32"))
        .when(F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("FEFF")), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )
