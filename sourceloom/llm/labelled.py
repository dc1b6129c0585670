"""Bounded samples of labelled documents, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the documents, whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, y) of at most ``bound`` labelled rows that aren't held out, lowest hash first.

    The sampled label rows are at most ``bound``, so they can be broadcast.  Of
    documents that share an id, and so a label, the one with the lowest hash of its
    text stands for all: there are no more rows than label rows.
    """
    rows = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(bound)
    )
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")
    return joined.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.md5("text"))).alias("text")).select("text", "y")
