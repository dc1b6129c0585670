"""Near-duplicates by DartMinHash.

A text is the multiset of its five-word shingles (a text of fewer words, but not
none, is one shingle); the similarity of two texts is the weighted Jaccard index
of their multisets, and texts of ``SIMILARITY`` or more are linked.  Classes are
the connected components of the links.

Signatures: darts fall on the plane of weights and ranks of each shingle, as a
Poisson process of unit density that only hashes decide.  A text keeps the darts
below its shingles' weights whose rank is below t / (total weight), about
t = k ln k + 2 k of them whatever its length, and the earliest dart of each of k
coordinates is its signature.  Weights and ranks are both cut into regions that
double in size, so a text only looks at the regions it needs: a shingle that
occurs a thousand times takes ten regions of weight, not a thousand cells.

Candidates: the signature is cut into bands; texts that share a band form a
bucket.  A bucket is never expanded into all pairs: its members are compared
with the one that shares most buckets with others, and the links are merged to
components.  Where a bucket then holds several, its members are joined on the
rarest of their shingles: two texts of this similarity share one of the first
(1 - similarity) of their shingles in any common order, rarest first.  Pairs
whose lengths and places in that order rule the similarity out go, and of texts
of one component none is compared.  A comparison counts shared cells exactly.

Defined results: a null text is a class of its own; texts without words are in
a class with equal texts only; copies and repeated rows share their class; null
ids come after all others when the class id is chosen; an empty table gives no
rows; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import discard, free_name, releasing, row_chunks, stage_table, text_buffers
from sourceloom.llm.components import connected_components
from sourceloom.llm.words import mix, words

SHINGLE = 5
SIMILARITY = 0.8
#: Members of a cell that are compared in one task, about.
CELL_ROWS = 4096
BANDS, ROWS = 25, 5

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(71).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * U64(2) + U64(1)
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
_LOWEST = 2.0**-3


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle occurrence, by text."""
    w = words(data, offs)
    text_of = w.text_of
    count = np.diff(w.first)
    h = w.hashes
    if len(h) >= SHINGLE:
        at = np.flatnonzero(text_of[: len(h) - SHINGLE + 1] == text_of[SHINGLE - 1 :])
        value = h[at] * _FACTORS[0]
        for k in range(1, SHINGLE):
            value += h[at + k] * _FACTORS[k]
        owner = text_of[at]
    else:
        value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = count[short] > k
            extra[has] += h[w.first[short[has]] + k] * _FACTORS[k]
        value, owner = np.concatenate([value, extra + count[short].astype(np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return owner, mix(value)


def _grouped(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal shingles of a text together, and where each one begins in it."""
    salted = value ^ mix(owner.astype(np.uint64) + U64(1))
    order = np.argsort(salted, kind="stable")
    ordered = salted[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])


def weighted(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of the distinct shingles of each text."""
    order, first = _grouped(owner, value)
    return owner[order[first]], value[order[first]], np.diff(np.append(first, len(order))).astype(float)


def cells(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hashes that are distinct in each text: the j-th repeat of a shingle is cell j of its weight."""
    order, first = _grouped(owner, value)
    if len(first) == len(order):
        return value
    size = np.diff(np.append(first, len(order)))
    repeat = np.empty(len(order), np.uint64)
    repeat[order] = (np.arange(len(order)) - np.repeat(first, size)).astype(np.uint64)
    return value + repeat * _STEP


def _poisson_table(area: float) -> np.ndarray:
    """Distribution function of the number of darts in a region of one cell."""
    top = int(area + 12 * math.sqrt(area) + 24)
    logs = np.array([i * math.log(area) - area - math.lgamma(i + 1) for i in range(top)])
    return np.cumsum(np.exp(logs))


_tables: dict[float, np.ndarray] = {}


def _poisson(area: float) -> np.ndarray:
    if area not in _tables:
        _tables[area] = _poisson_table(area)
    return _tables[area]


def _part(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers from 0 to 1."""
    return (x >> U64(11)) * 2.0**-53


def _region(m: int, least: float) -> tuple[float, float]:
    """Lower end and size of region m."""
    return (0.0, least) if m == 0 else (least * 2.0 ** (m - 1), least * 2.0 ** (m - 1))


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """n x k signatures of the texts' distinct elements and their weights; rows of texts without any are all _EMPTY."""
    signature = np.full(n * k, _EMPTY, np.uint64)
    total = np.bincount(owner, weight, minlength=n)
    filled = total > 0
    darts = k * math.log(k) + 2 * k
    while len(element):
        limit = darts / total[owner]
        v = 0
        while True:
            left, width = _region(v, 1.0)
            heavy = np.flatnonzero(weight > left)
            if not len(heavy):
                break
            m = 0
            while True:
                low, height = _region(m, _LOWEST)
                at = heavy[limit[heavy] > low]
                if not len(at):
                    break
                region = mix(element[at] + U64(((m + 1) * int(_STEP) + v * 0xD6E8FEB86659FD93) % (1 << 64)))
                number = np.searchsorted(_poisson(width * height), _part(region), side="right")
                which = np.repeat(np.arange(len(at)), number)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
                dart = mix(region[which] + (nth + 1).astype(np.uint64) * U64(0xD1342543DE82EF95))
                source = at[which]
                under = (low + height * _part(dart) < limit[source]) & (left + width * _part(mix(dart + _STEP)) < weight[source])
                dart, source = dart[under], source[under]
                coordinate = ((dart & U64(0xFFFFFFFF)) * U64(k)) >> U64(32)
                np.minimum.at(signature, owner[source] * k + coordinate.astype(np.int64), (U64(m) << U64(58)) | (dart >> U64(6)))
                m += 1
            v += 1
        open_rows = (signature.reshape(n, k) == _EMPTY).any(axis=1) & filled
        again = open_rows[owner]
        owner, element, weight, darts = owner[again], element[again], weight[again], darts * 2
    return signature.reshape(n, k)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of the bands."""
    n = len(signature)
    bands = signature.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * _STEP + bands[:, :, r])
    return key


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (null for a null text), bands (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for i, j in row_chunks(offs):
                owner, value = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                keys = band_keys(dart_signatures(*weighted(owner, value), j - i)).view(np.int64)
                full = np.bincount(owner, minlength=j - i) > 0
                cut = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(cut), pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i), bands], ["doc_id", "text_key", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.unhex(F.md5("text")).alias("text_key"))
    return rows.mapInArrow(releasing(run), "doc_id long, text_key binary, bands array<long>")


def _cell_lists(texts: DataFrame) -> DataFrame:
    """item, cells (sorted 64-bit hashes) of (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for i, j in row_chunks(offs):
                owner, value = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                cell = cells(owner, value)
                cut = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                cell = cell[np.lexsort((cell, owner))].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("item").slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut), pa.array(cell))], ["item", "cells"])

    return texts.mapInArrow(releasing(run), "item long, cells array<long>")


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of (a, b, ca, cb) whose weighted Jaccard index is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ca"), batch.column("cb"), strict=True):
                p, q = x.values.to_numpy(), y.values.to_numpy()
                if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                    keep.append(False)  # too different in weight
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())  # cells of one text are distinct
                keep.append(shared >= similarity * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(releasing(run), "a long, b long")


def _compared(pairs: DataFrame, lists: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of items that are similar enough, by their (item, cells)."""
    first, second = (lists.select(F.col("item").alias(x), F.col("cells").alias(f"c{x}")) for x in "ab")
    return _verified(pairs.join(first, "a").join(second, "b"), similarity)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, kept.

    ``class_id`` is the smallest id of the class; ``kept`` marks the document of
    that id (all repeated rows of it alike).
    """
    signed = stage_table(_signed(docs), "darts")
    items = signed.filter("text_key IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("first_doc"), F.any_value("bands").alias("bands"))
    items = stage_table(items.withColumn("item", F.monotonically_increasing_id()), "items")
    labels = _class_labels(docs, items, similarity)
    named = items.select("text_key", "item", "first_doc")
    if labels is not None:
        named = named.join(labels, "item", "left").withColumn("label", F.coalesce("label", "item"))
        classes = named.groupBy("label").agg(F.min("first_doc").alias("class_id"))
        named = named.join(classes, "label")
    else:
        named = named.withColumn("class_id", F.col("first_doc"))
    out = signed.select("doc_id", "text_key").join(named.select("text_key", "class_id"), "text_key", "left")
    own = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", "text_key", F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(own).alias("class_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _rarest(members: DataFrame, similarity: float) -> DataFrame:
    """cell, item, label, size, place: the cells of (item, label, cells) by which texts of this similarity meet.

    In the order of their frequency, of a text's ``size`` cells the first
    size - similarity * size + 1 are enough.  Cells of one text alone come first
    and meet nothing, so they are left out.
    """
    spread = members.select("item", "label", F.size("cells").alias("size"), F.explode("cells").alias("cell"))
    shared = spread.groupBy("cell").agg(F.count("*").alias("frequency")).filter("frequency > 1")
    own = Window.partitionBy("item")
    met = spread.join(shared, "cell").withColumn("place", F.row_number().over(own.orderBy("frequency", "cell")) + F.col("size") - F.count("*").over(own))
    return met.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).drop("frequency")


def _class_labels(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame | None:
    """(item, label) of the items that have links; None if no two items share a bucket."""
    spread = items.select("item", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = stage_table(spread.join(shared, "key"), "buckets")
    if buckets.isEmpty():
        discard(buckets)
        return None
    degree = buckets.groupBy("item").agg(F.sum("members").alias("degree"))
    members = items.join(degree, "item").select("item", "text_key", "first_doc")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.unhex(F.md5("text")).alias("text_key"))
    found = texts.join(members, (texts.text_key == members.text_key) & texts.doc_id.eqNullSafe(members.first_doc)).select("item", "text")
    lists = stage_table(_cell_lists(found).dropDuplicates(["item"]), "cells")  # repeated rows give equal lists

    # all members of a bucket against the one that shares most with others
    centre = buckets.join(degree, "item").groupBy("key").agg(F.max_by("item", F.struct("degree", -F.col("item"))).alias("lead"))
    pairs = buckets.join(centre, "key").filter("item <> lead").select(F.least("item", "lead").alias("a"), F.greatest("item", "lead").alias("b")).distinct()
    links = stage_table(_compared(pairs, lists, similarity), "links")
    parts_of = connected_components(links)
    labelled = buckets.join(parts_of, "item", "left").select("key", "item", F.coalesce("label", "item").alias("label"))

    # members of buckets with several components, where they share one of their rarest cells
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    again = stage_table(labelled.join(mixed, "key").select("item", "label").distinct().join(lists, "item"), "mixed-items")
    discard(buckets, parts_of, lists)
    rarest = stage_table(_rarest(again, similarity), "rarest-cells")
    parts = rarest.groupBy("cell", "label").agg(F.count("*").alias("n"))
    several = parts.groupBy("cell").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.ceil(F.sum("n") / CELL_ROWS).alias("blocks")).filter("parts > 1").drop("parts")
    rows = rarest.join(several, "cell").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")))
    # a cell of many members is dealt to blocks: each member to one of them, those outside the main component to all
    outside = rows.filter("label <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    outside = outside.select(*[F.col(c).alias(f"o_{c}") for c in rows.columns])
    rest = F.least(F.col("size") - F.col("place"), F.col("o_size") - F.col("o_place")) + 1  # cells that can be shared from here on
    fits = rest >= (F.col("size") + F.col("o_size")) * (similarity / (1 + similarity)) - 1e-9
    met = rows.join(outside, (rows.cell == outside.o_cell) & (rows.block == outside.o_block) & (F.col("label") != F.col("o_label")) & fits)
    pairs = met.select(F.least("item", "o_item").alias("a"), F.greatest("item", "o_item").alias("b")).distinct()
    more = stage_table(_compared(pairs, again, similarity), "links")
    discard(rarest, again)
    labels = connected_components(links.union(more))
    discard(links, more)
    return labels


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns; of repeated rows one."""
    own_id, own_key, kept_id, kept_key = (free_name(docs, n) for n in ("own_id", "own_key", "kept_id", "kept_key"))
    kept = near_duplicates(docs, similarity).filter("kept")
    no_text = F.lit(b"")
    kept = kept.select(F.col("doc_id").alias(kept_id), F.coalesce("text_key", no_text).alias(kept_key)).distinct()
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_key: F.coalesce(F.unhex(F.md5(F.col("text").cast("string"))), no_text)})
    joined = keyed.join(kept, F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_key) == F.col(kept_key)), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = joined.groupBy(own_id, own_key).agg(F.min_by(whole, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias(free_name(docs, "whole")))
    return one.select(f"{free_name(docs, 'whole')}.*")
