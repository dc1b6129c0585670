"""Resharding by minimum-cost flow.

Given the byte sizes of the old shards and the capacities of the new ones, the
planner finds the block transfers that move the fewest bytes; every document is
then placed by the position of its bytes in its old shard, and only files that
give or get blocks are rewritten.

Only one row per old shard reaches the driver (file metadata, not documents).
Prefix sums run in two levels (pieces of a shard, documents of a piece), so no
shard is ever collected into one task.

Defined results: a null text counts as 0 bytes and has crc 0; null ids come
first; repeated rows are separate documents; an empty table gives no rows; only
the id, text and shard columns are read, so other columns can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sourceloom.llm.common import discard, free_name, stage_table

OVERHEAD = 16
#: Pieces that the stream of one old shard is cut into for prefix sums.
PIECES = 1024
#: Bytes of text that one task writes of a new shard, about.
WRITE_BYTES = 64 << 20


class FlowNetwork:
    """Minimum-cost flow by successive shortest paths with potentials."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.edges: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """Saturate; the flow and its cost."""
        n, flow, cost = len(self.edges), 0, 0
        potential = [0] * n
        while True:
            dist: list[float] = [float("inf")] * n
            via = [-1] * n
            dist[source] = 0
            heap: list[tuple[float, int]] = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for e in self.edges[a]:
                    b = self.to[e]
                    if self.left[e] and d + self.cost[e] + potential[a] - potential[b] < dist[b]:
                        dist[b] = d + self.cost[e] + potential[a] - potential[b]
                        via[b] = e
                        heapq.heappush(heap, (dist[b], b))
            if via[sink] < 0:
                return flow, cost
            for v in range(n):
                if dist[v] < float("inf"):
                    potential[v] += int(dist[v])
            # send along every shortest path of this length at once
            sent = self._augment(source, sink, potential)
            flow += sent
            cost += sent * (potential[sink] - potential[source])

    def _augment(self, source: int, sink: int, potential: list[int]) -> int:
        """Blocking flow over the edges of reduced cost 0, depth first without recursion."""
        total, place = 0, [0] * len(self.edges)
        while True:
            path: list[int] = []
            a = source
            on = {a}
            while a != sink:
                while place[a] < len(self.edges[a]):
                    e = self.edges[a][place[a]]
                    b = self.to[e]
                    if self.left[e] and b not in on and self.cost[e] + potential[a] - potential[b] == 0:
                        break
                    place[a] += 1
                if place[a] == len(self.edges[a]):
                    if not path:
                        return total
                    on.discard(a)
                    a = self.to[path.pop() ^ 1]
                    place[a] += 1
                    continue
                path.append(e)
                a = b
                on.add(a)
            amount = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= amount
                self.left[e ^ 1] += amount
            total += amount


def capacities(total: int, shards: int) -> list[int]:
    """Equal byte capacities that sum to ``total``."""
    return [total * (i + 1) // shards - total * i // shards for i in range(shards)]


def plan_transfers(sizes: Sequence[int], caps: Sequence[int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) of the flow that moves the fewest bytes.

    Old shard ``i`` lives where new shard ``i`` will; bytes that stay cost
    nothing, any other byte costs 1.  Moves run over one hub, so the network has
    a number of edges that is linear in the number of shards.
    """
    old, new = len(sizes), len(caps)
    hub, source, sink = old + new, old + new + 1, old + new + 2
    net = FlowNetwork(old + new + 3)
    total = sum(sizes)
    stay: dict[int, int] = {}
    out: dict[int, int] = {}
    into: dict[int, int] = {}
    for i, size in enumerate(sizes):
        net.add(source, i, size, 0)
        if i < new:
            stay[i] = net.add(i, old + i, min(size, caps[i]), 0)
        out[i] = net.add(i, hub, size, 1)
    for j, cap in enumerate(caps):
        into[j] = net.add(hub, old + j, total, 0)
        net.add(old + j, sink, cap, 0)
    flow, _ = net.run(source, sink)
    if flow != total:
        raise ValueError("the capacities are smaller than the data")
    plan = [(i, i, net.left[e ^ 1]) for i, e in stay.items() if net.left[e ^ 1]]
    gives = [[i, net.left[e ^ 1]] for i, e in out.items() if net.left[e ^ 1]]
    takes = [[j, net.left[e ^ 1]] for j, e in into.items() if net.left[e ^ 1]]
    while gives and takes:  # the hub's flow, taken apart into transfers
        (i, a), (j, b) = gives[-1], takes[-1]
        plan.append((i, j, min(a, b)))
        for side, rest in ((gives, a - min(a, b)), (takes, b - min(a, b))):
            if rest:
                side[-1][1] = rest
            else:
                side.pop()
    return sorted(plan)


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def crc_of(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")


def _piece(row_id: Column | None = None) -> Column:
    """By what tells rows apart, so that one id, or the null id, fills no piece alone."""
    return F.pmod(F.xxhash64("doc_id", crc_of(F.col("text")), *([] if row_id is None else [row_id.cast("long")])), F.lit(PIECES)).cast("int")


#: The order of documents in an old shard, and in a new one (there by old shard before the row).
_KEY = ["piece", "doc_id", "text_crc32", "size"]


def reshard(docs: DataFrame, shards: int, old_shard: Column, row_id: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, old_shard, shard, slot; and piece, row_id.

    ``old_shard`` names the old shard of each row, e.g. its file; ``row_id`` tells
    its rows apart at every reading, e.g. their places in the file.
    """
    spark = docs.sparkSession
    meta = docs.select(
        "doc_id", size_of(F.col("text")).alias("size"), crc_of(F.col("text")).alias("text_crc32"),
        old_shard.cast("string").alias("old_name"), _piece(row_id).alias("piece"),
        (F.monotonically_increasing_id() if row_id is None else row_id.cast("long")).alias("row_id"),
    )
    meta = stage_table(meta, "reshard-meta")
    pieces = meta.groupBy("old_name", "piece").agg(F.sum("size").alias("piece_size"))
    along = Window.partitionBy("old_name").orderBy("piece")
    pieces = pieces.withColumn("piece_start", F.sum("piece_size").over(along) - F.col("piece_size"))

    sizes = {r["old_name"]: r["size"] for r in meta.groupBy("old_name").agg(F.sum("size").alias("size")).collect()}  # one row per file
    names = sorted(sizes, key=lambda x: (x is None, x))
    plan = plan_transfers([sizes[n] for n in names], capacities(sum(sizes.values()), shards))
    cuts, at = [], dict.fromkeys(range(len(names)), 0)
    for i, j, amount in plan:
        cuts.append((names[i], at[i], j))
        at[i] += amount
    cut_table = (
        spark.createDataFrame(cuts, "old_name string, cut long, to int")
        .groupBy("old_name")
        .agg(F.sort_array(F.collect_list(F.struct("cut", "to"))).alias("cuts"))
    )  # at most one cut per old and new shard, in all
    within = Window.partitionBy("old_name", "piece").orderBy("doc_id", "text_crc32", "size", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("piece_start") + F.sum("size").over(within) - F.floor((F.col("size") + 1) / 2)
    placed = (
        meta.alias("m").join(pieces.alias("p"), F.col("m.old_name").eqNullSafe(F.col("p.old_name")) & (F.col("m.piece") == F.col("p.piece")))
        .select("m.*", "piece_start").withColumn("middle", middle).alias("d")
        .join(cut_table.alias("c"), F.col("d.old_name").eqNullSafe(F.col("c.old_name")))
        .withColumn("shard", F.array_max(F.filter("cuts", lambda c: c["cut"] <= F.col("middle")))["to"])
        .select("d.doc_id", "d.size", "d.text_crc32", "d.old_name", "d.piece", "d.row_id", "shard")
    )
    placed = stage_table(placed, "reshard-placed")
    order = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size", "old_name", "row_id")
    slot = (F.col("first") + F.row_number().over(order) - 1).cast("long")
    return placed.join(_first_slots(placed), ["shard", "piece"]).withColumn("slot", slot).select("doc_id", "size", "text_crc32", F.col("old_name").alias("old_shard"), "shard", "slot", "piece", "row_id")


def _first_slots(placed: DataFrame) -> DataFrame:
    """shard, piece, first: the slot of the first document of each piece of a new shard."""
    counts = placed.groupBy("shard", "piece").count()
    return counts.select("shard", "piece", (F.sum("count").over(Window.partitionBy("shard").orderBy("piece")) - F.col("count")).alias("first"))


def shard_names(placed: DataFrame) -> list[str | None]:
    """The old shards that hold documents, in the planner's order."""
    return sorted((r[0] for r in placed.select("old_shard").distinct().collect()), key=lambda x: (x is None, x))  # one row per file


def rewrite(docs: DataFrame, placed: DataFrame, names: Sequence[str | None], path: str, old_shard: Column | None = None, row_id: Column | None = None) -> list[int]:
    """Write the new shards whose rows differ from the old ones; their numbers.

    A new shard that keeps all rows of its old file, and gets none, is left as
    it is.  ``names`` are the old shards in the planner's order.  Every row of
    ``docs`` is written once, with all its columns, its shard as the folder and
    its slot (``shard`` and ``slot``, with underscores where ``docs`` has them).

    With the ``old_shard`` and ``row_id`` that ``reshard`` had, a row finds its
    shard by the first rows that each old shard gives to each new one, so texts
    are shuffled once.  Without them rows are paired with placements of the same
    id, size and crc, one to one.
    """
    spark = docs.sparkSession
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, old_number int")
    moves = placed.join(F.broadcast(order), F.col("old_shard").eqNullSafe(F.col("name")), "left").groupBy("shard", "old_number").count().filter("NOT shard <=> old_number").collect()  # one row per transfer
    affected = sorted({r["shard"] for r in moves} | {r["old_number"] for r in moves if r["old_number"] is not None})
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    key = [_piece(row_id).alias("piece"), F.col("doc_id"), crc_of(F.col("text")).alias("text_crc32"), size_of(F.col("text")).alias("size")]
    if old_shard is None or row_id is None:
        nth = Window.partitionBy("doc_id", "text_crc32", "size")
        own = docs.select(whole, *key).withColumn("nth", F.row_number().over(nth.orderBy(F.xxhash64(F.to_json("whole")))))
        rows = placed.withColumn("nth", F.row_number().over(nth.orderBy("shard", "slot"))).filter(F.col("shard").isin(affected))
        same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "text_crc32", "size", "nth")]
        found = own.alias("d").join(rows.alias("p"), same).select("d.whole", "p.shard", "p.slot").repartition("shard").sortWithinPartitions("shard", "slot")
    else:
        firsts = placed.groupBy("old_shard", "shard").agg(F.min(F.struct(*_KEY, "row_id")).alias("first"))
        firsts = firsts.groupBy("old_shard").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("firsts"))  # one entry per transfer
        own = docs.select(whole, *key, row_id.cast("long").alias("row_id"), old_shard.cast("string").alias("old_name"))
        at = F.size(F.filter("firsts", lambda f: f["first"] <= F.struct(*_KEY, "row_id")))
        own = own.join(F.broadcast(firsts), F.col("old_name").eqNullSafe(F.col("old_shard"))).withColumn("shard", F.element_at("firsts", at)["shard"])
        own = own.drop("firsts", "old_shard").filter(F.col("shard").isin(affected))
        largest = placed.groupBy("shard").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0
        parts = min(PIECES, max(1, -(-largest // WRITE_BYTES)))
        own = own.withColumn("part", F.floor(F.col("piece") * parts / PIECES).cast("int")).repartition("shard", "part")
        within = Window.partitionBy("shard", "part", "piece").orderBy("doc_id", "text_crc32", "size", "old_name", "row_id")
        found = own.withColumn("nth", F.row_number().over(within)).join(F.broadcast(_first_slots(placed)), ["shard", "piece"])
        found = found.select("whole", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    found.select("whole.*", F.col("shard").alias(shard), F.col("slot").alias(slot)).write.partitionBy(shard).parquet(path)
    return affected


def reshard_files(docs: DataFrame, shards: int, path: str) -> DataFrame:
    """Move Parquet files to ``shards`` shards; doc_id, size, text_crc32, shard, slot as read back.

    Old shards are the files of ``docs``.  Affected shards are written under
    ``path``; the others are read where they are, a row's slot being its place in the file.
    """
    spark = docs.sparkSession
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    placed = stage_table(reshard(docs, shards, file, row), "reshard-plan")
    names = shard_names(placed)
    affected = rewrite(docs, placed, names, path, file, row)
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    found = []
    if affected:
        schema = StructType([*docs.schema.fields, StructField(slot, LongType()), StructField(shard, IntegerType())])
        found.append(spark.read.schema(schema).parquet(path).select("doc_id", "text", F.col(f"`{shard}`").alias("shard"), F.col(f"`{slot}`").alias("slot")))
    left = [(n, i) for i, n in enumerate(names) if i not in set(affected)]
    if left or not affected:
        kept = F.broadcast(spark.createDataFrame(left, "name string, shard int"))
        own = docs.select("doc_id", "text", file.alias("file"), row.alias("slot"))
        found.append(own.join(kept, F.col("file") == F.col("name")).select("doc_id", "text", "shard", "slot"))
    rows = found[0] if len(found) == 1 else found[0].union(found[1])
    discard(placed)
    return rows.select("doc_id", size_of(F.col("text")).alias("size"), crc_of(F.col("text")).alias("text_crc32"), "shard", "slot")
