"""Interval algebra: islands, containment, owners, chains.

Every join has the group's keys as equi-keys, so that it is a hash or merge join
with the range as its residual condition.  Where one group may be huge, ``bins``
turns the range into an equi-key as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, keys: Sequence[str], start: str, end: str, *ties: str) -> DataFrame:
    """Add ``island``, from 0 in each group: touching or overlapping spans share one."""
    order = Window.partitionBy(*keys).orderBy(start, end, *ties)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    return spans.withColumn("_new", new).withColumn("island", (F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_new")


def island_spans(spans: DataFrame, keys: Sequence[str], start: str, end: str, *ties: str) -> DataFrame:
    """One row per island: its span, first and last member, sorted distinct kinds if there are any."""
    marked = islands(spans, keys, start, end, *ties)
    order = F.struct(start, end, *ties)
    return marked.groupBy(*keys, "island").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"),
        *[F.min_by(t, order).alias(f"first_{t}") for t in ties], *[F.max_by(t, order).alias(f"last_{t}") for t in ties],
    )


def containing(inner: DataFrame, outer: DataFrame, keys: Sequence[str], how: str = "inner", bins: int | None = None, strict: bool = False) -> DataFrame:
    """Rows of ``inner`` with those of ``outer`` that contain them.

    Both have ``keys``, ``start``, ``end`` and ``ord`` (the place among equal spans,
    larger is deeper); the columns of ``outer`` get the prefix ``o_``.  ``strict``
    asks for an ``ord`` below the inner one's, for joins of a table with itself.
    With ``bins``, outer spans are listed in every bin that they touch.
    """
    renamed = outer.select(*[F.col(c).alias(f"o_{c}") for c in outer.columns])
    on = [inner[k].eqNullSafe(renamed[f"o_{k}"]) for k in keys]
    if bins:
        inner = inner.withColumn("_bin", F.floor(F.col("start") / bins))
        renamed = renamed.withColumn("_obin", F.explode(F.sequence(F.floor(F.col("o_start") / bins), F.floor(F.col("o_end") / bins))))
        on.append(F.col("_bin") == F.col("_obin"))
    on += [F.col("o_start") <= F.col("start"), F.col("o_end") >= F.col("end")]
    if strict:
        on.append(F.col("o_ord") < F.col("ord"))
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    out = inner.join(renamed, condition, how)
    return out.drop("_bin", "_obin") if bins else out


def place_in_order(spans: DataFrame, keys: Sequence[str], *ties: str) -> DataFrame:
    """Add ``ord``: the place by start, then longest first, then the ties."""
    return spans.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("start", F.col("end").desc(), *ties)))


def parents(spans: DataFrame, keys: Sequence[str], key: str, bins: int | None = None) -> DataFrame:
    """(key, parent): the innermost span that contains each; null at the top."""
    ordered = place_in_order(spans, keys, key)
    best = containing(ordered, ordered, keys, "left", bins, strict=True)
    return best.groupBy(key).agg(F.max_by(f"o_{key}", "o_ord").alias("parent"))


def smallest_owner(inner: DataFrame, outer: DataFrame, keys: Sequence[str], key: str, owner: str, bins: int | None = None) -> DataFrame:
    """(key, owner): the containing span of the smallest area, the first on a tie."""
    found = containing(inner, outer, keys, "left", bins)
    return found.groupBy(key).agg(F.min_by(f"o_{owner}", F.struct(F.col("o_end") - F.col("o_start"), "o_start", "o_ord")).alias("owner"))


def innermost_owner(inner: DataFrame, outer: DataFrame, keys: Sequence[str], key: str, owner: str, bins: int | None = None) -> DataFrame:
    """(key, owner): the last containing span by (start, longest first), the last on a tie."""
    found = containing(inner, outer, keys, "left", bins)
    return found.groupBy(key).agg(F.max_by(f"o_{owner}", F.struct("o_start", -F.col("o_end"), "o_ord")).alias("owner"))


def nested(spans: DataFrame, keys: Sequence[str], key: str, name: Column, separator: str = "::", bins: int | None = None) -> DataFrame:
    """(key, depth, chain, parent): enclosing spans counted, their names from the top with the span's own, and the innermost of them."""
    ordered = place_in_order(spans.withColumn("name", name), keys, key)
    found = containing(ordered, ordered, keys, "left", bins, strict=True)
    return found.groupBy(key, "name").agg(
        F.count("o_ord").alias("depth"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("o_ord").isNotNull(), F.struct("o_ord", "o_name")))), lambda x: x["o_name"]), separator).alias("_above"),
        F.max_by(f"o_{key}", "o_ord").alias("parent"),
    ).select(key, "depth", F.concat_ws(separator, F.when(F.col("_above") != "", F.col("_above")), "name").alias("chain"), "parent")


def chains(spans: DataFrame, keys: Sequence[str], key: str, name: Column, separator: str = "::", bins: int | None = None) -> DataFrame:
    """(key, depth, chain): enclosing spans counted, and their names from the top, with the span's own."""
    return nested(spans, keys, key, name, separator, bins).drop("parent")
