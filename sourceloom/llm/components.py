"""Connected components of a table of links, by hooking to smaller labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import discard, stage_table

#: Pieces that the rows of one label are dealt to where labels are looked up.
SALTS = 8


def _looked_up(rows: DataFrame, key: str, other: str, parent: DataFrame, out: Column) -> DataFrame:
    """``rows`` with ``out``, which names parent.p, the parent of ``key`` (null if it has none).

    Very many rows may have one key, so they are dealt by ``other`` as well.
    """
    wide = parent.select(F.col("a").alias("_a"), "p", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    joined = salted.join(wide, (F.col(key) == F.col("_a")) & (F.col("_s") == F.col("_salt")), "left")
    return joined.withColumn(key, out).drop("_a", "_s", "_salt", "p")


def connected_components(links: DataFrame) -> DataFrame:
    """(item, label) of every item of ``links`` (a, b); label is an item of its component.

    In a round every label hooks to its smallest neighbour, chains are cut short
    by pointer jumping, and the links are rewritten between the new labels.  All
    tables stay distributed; the driver only learns whether links are left.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    labels = both.select(F.col("a").alias("item")).distinct().withColumn("label", F.col("item"))
    labels = stage_table(labels, "component-labels")
    edges, old = both.distinct(), []
    while True:
        edges = stage_table(edges, "component-edges")
        discard(*old)
        if edges.isEmpty():
            discard(edges)
            return labels
        hooks = stage_table(edges.groupBy("a").agg(F.min("b").alias("p")).filter("p < a"), "component-hooks")
        jumped = hooks.withColumnRenamed("p", "q")
        for _ in range(2):
            jumped = _looked_up(jumped, "q", "a", hooks, F.coalesce("p", "q"))
        parent = stage_table(jumped.withColumnRenamed("q", "p"), "component-parents")
        old = [edges, hooks, parent, labels]
        up = F.coalesce("p", "label")
        labels = stage_table(_looked_up(labels, "label", "item", parent, up), "component-labels")
        edges = _looked_up(_looked_up(edges, "a", "b", parent, F.coalesce("p", "a")), "b", "a", parent, F.coalesce("p", "b"))
        edges = edges.filter("a <> b").distinct()
