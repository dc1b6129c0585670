"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are windows of ``WINDOW`` consecutive words of each benchmark item
(a shorter item is one pattern).  Words are the symbols.  A shift table over
blocks of two words skips positions at which no pattern can end; where the shift
is 0, the suffix hash selects a bucket of patterns, and a comparison of hashes
and then of the words' own bytes confirms an occurrence.  The scan runs in lanes
that advance together, so numpy does the work of the inner loop.

The benchmark is a stated query set.  It is sent to the tasks in blocks of at
most ``block_bytes`` of text (or of one item) each; the hits of several blocks are
merged.

Defined results: null and empty texts have no words and are clean; items
without words match nothing; repeated rows are separate documents; equal items
count as often as they have ids; items without an id are one item, whose words count as hits and which
counts as one in ``n_items``, but not in ``items_sha256``; an empty benchmark
leaves every document clean; only the id and text
columns of both tables are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import releasing, row_chunks, text_buffers
from sourceloom.llm.words import Words, words

WINDOW = 10
BLOCK_BYTES = 8 << 20
LANE = 128
_TABLE_BITS = 18

SCHEMA = "doc_id long, digest string, n_words long, spans array<struct<lo:long,hi:long>>, items array<long>"


class PatternGroup:
    """Shift table, suffix buckets and patterns of one length."""

    def __init__(self, length: int, hashes: np.ndarray, texts: list[tuple[bytes, ...]], items: list[list[int]]) -> None:
        self.length, self.block = length, min(2, length)
        suffix = self._block(hashes[:, length - 1], hashes[:, length - 2] if self.block == 2 else None)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.hashes = suffix[order], hashes[order]
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]
        self.shift = np.full(1 << _TABLE_BITS, length - self.block + 1, np.int64)
        for end in range(self.block - 1, length):
            at = self._block(hashes[:, end], hashes[:, end - 1] if self.block == 2 else None)
            np.minimum.at(self.shift, (at >> np.uint64(64 - _TABLE_BITS)).astype(np.int64), length - 1 - end)

    @staticmethod
    def _block(last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        value = last * np.uint64(0x9E3779B97F4A7C15)
        return value if before is None else (value ^ before) * np.uint64(0xC2B2AE3D27D4EB4F)

    def scan(self, w: np.ndarray) -> np.ndarray:
        """Positions at which a pattern may end."""
        n, found = len(w), []
        at = np.arange(0, n, LANE)
        stop = np.minimum(at + LANE, n)
        at = np.maximum(at, self.length - 1)
        live = at < stop
        at, stop = at[live], stop[live]
        while len(at):
            block = self._block(w[at], w[at - 1] if self.block == 2 else None)
            shift = self.shift[(block >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
            hit = shift == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, text: Words, text_of: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every confirmed occurrence."""
        ends = self.scan(text.hashes)
        ends = ends[text_of[ends] == text_of[ends - self.length + 1]]
        key = self._block(text.hashes[ends], text.hashes[ends - 1] if self.block == 2 else None)
        lo, hi = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        count = hi - lo
        end = np.repeat(ends, count)
        pattern = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(ends) else np.zeros(0, np.int64)
        for k in range(self.length):  # the prefix first: most wrong ones go at once
            same = text.hashes[end - self.length + 1 + k] == self.hashes[pattern, k]
            end, pattern = end[same], pattern[same]
        raw = text.lower
        for e, p in zip(end.tolist(), pattern.tolist(), strict=True):
            first = e - self.length + 1
            if all(raw[text.starts[first + k] : text.ends[first + k]].tobytes() == word for k, word in enumerate(self.texts[p])):
                yield first, p


def _nulls_last(item: int | None) -> tuple[bool, int | None]:
    return item is None, item


def pattern_groups(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[PatternGroup]:
    """The patterns of a block of the benchmark, by length."""
    encoded = [(x[1] or "").encode() for x in items]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
    w = words(np.frombuffer(b"".join(encoded), np.uint8), offs)
    found: dict[tuple[bytes, ...], tuple[np.ndarray, set[int | None]]] = {}
    for i, (item, _) in enumerate(items):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        size = min(window, hi - lo)
        tokens = [w.lower[a:b].tobytes() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi], strict=True)]
        for k in range(hi - lo - size + 1 if size else 0):
            found.setdefault(tuple(tokens[k : k + size]), (w.hashes[lo + k : lo + k + size], set()))[1].add(item)
    groups = []
    for length in sorted({len(k) for k in found}):
        own = [(k, *v) for k, v in found.items() if len(k) == length]
        groups.append(PatternGroup(length, np.stack([x[1] for x in own]), [x[0] for x in own], [sorted(x[2], key=_nulls_last) for x in own]))
    return groups


def search_texts(groups: list[PatternGroup], data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
    """Words of each text; by text, its merged hit spans (in words) and its items."""
    w = words(data, offs)
    text_of = w.text_of
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    items: dict[int, set[int]] = {}
    for g in groups:
        for first, p in g.occurrences(w, text_of):
            edge[first] += 1
            edge[first + g.length] -= 1
            items.setdefault(int(text_of[first]), set()).update(g.items[p])
    spans: dict[int, list[tuple[int, int]]] = {}
    if items:
        hit = np.cumsum(edge[:-1]) > 0
        step = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
        cut = w.first[:-1]
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            while a < b:  # hits of adjacent texts touch
                t = int(text_of[a])
                end = min(b, int(w.first[t + 1]))
                spans.setdefault(t, []).append((a - int(cut[t]), end - int(cut[t])))
                a = end
    return np.diff(w.first), spans, items


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans (hit words), items (ids found)."""
    parts = [_block_hits(docs, items, window) for items in _blocks(benchmark, block_bytes)]
    blocks = len(parts)
    if blocks == 1:
        return parts[0].drop("digest")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    merged = found.groupBy("doc_id", "digest", "n_words").agg(
        (F.count("*") / blocks).cast("int").alias("copies"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("digest", "copies", "copy")


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of at most ``block_bytes`` of text, or of one item; one block at least.

    Repeated items count once.  Items are dealt by a hash to buckets much smaller
    than a block, whose sizes are added up to blocks; a bucket over that size is
    dealt again.  All items without an id are one item.
    """
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    own = own.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)
    total, items = own.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()

    def dealt(rows: DataFrame, size: int, number: int, seed: int) -> Iterator[list[tuple[int | None, str | None]]]:
        if size <= block_bytes or number <= 1:
            yield [(r[0], r[1]) for r in rows.select("item_id", "text").collect()]
            return
        count = min(2 * number, 16 * -(-size // block_bytes))
        bucket = F.pmod(F.xxhash64(F.lit(seed), "item_id", "text"), F.lit(count))
        sizes = rows.groupBy(bucket.alias("bucket")).agg(F.sum("bytes"), F.count("*")).orderBy("bucket").collect()  # ``count`` rows at most
        together: list[int] = []
        held = 0
        for k, bytes_, n in sizes:
            if bytes_ > block_bytes:
                yield from dealt(rows.filter(bucket == k), bytes_, n, seed + 1)
                continue
            if held + bytes_ > block_bytes:
                yield from dealt(rows.filter(bucket.isin(together)), held, 1, seed)
                together, held = [], 0
            together.append(k)
            held += bytes_
        if together:
            yield from dealt(rows.filter(bucket.isin(together)), held, 1, seed)

    yield from dealt(own, total, items, 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    for items in _blocks(benchmark, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(pattern_groups(items, window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offs = text_buffers(batch.column("text"))
                clean = np.ones(len(batch), bool)
                for i, j in row_chunks(offs):
                    _, spans, _ = search_texts(held.value, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    clean[[i + r for r in spans]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(releasing(run), docs.schema)
    return docs


def _block_hits(docs: DataFrame, items: list[tuple[int, str | None]], window: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(pattern_groups(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = held.value
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for i, j in row_chunks(offs):
                n_words, spans, found = search_texts(groups, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                rows = range(j - i)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i), batch.column("digest").slice(i, j - i), pa.array(n_words, pa.int64()),
                    pa.array([[{"lo": a, "hi": b} for a, b in spans.get(r, ())] for r in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                    pa.array([sorted(found.get(r, ()), key=_nulls_last) for r in rows], pa.list_(pa.int64())),
                ], ["doc_id", "digest", "n_words", "spans", "items"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return rows.mapInArrow(releasing(run), SCHEMA)


def digest(hits: DataFrame) -> DataFrame:
    """The report row of each document."""
    hit_words = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["lo"], s["hi"] - 1))))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", F.size(hit_words).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
