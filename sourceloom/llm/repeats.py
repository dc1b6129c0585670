"""Removal of byte strings that repeat across documents, by sorted suffixes.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document
with a smaller id.  All strings are judged on the input.

1. Windows of ``LENGTH`` bytes are grouped into runs by their smallest hashed
   ``GRAM``-byte string, which equal windows share.  Runs whose smallest hash no
   other document has can't repeat; hashes are compared bucket by bucket.
2. The bytes of the other runs are dealt by that hash to shards that fit memory;
   where the runs of a hash have over ``HOT_BYTES``, each window is a row instead,
   and its smallest document comes from an aggregation by the window's bytes.
   Each shard sorts its suffixes by induced sorting; equal neighbours tell the
   smallest document of every window.
3. A document's flagged windows come together and its other bytes are kept.

Full external recursion over the whole corpus would put every suffix on disk,
which is over ten times the text; so shards are cut by content instead, and
Spark's shuffle is the disk-backed queue between them.

Hot groups: of runs with one hash in a batch, those of the smallest and of the
largest document go to the shared bucket, so that it sees several owners wherever
there are any, and the rest are settled as repeated on the spot (a task remembers
hashes that it has sent so, and need not send them again); of equal runs in a
batch, only that of the smallest document goes to a shard.  Hashes only bring
strings together: that they are equal is told by their bytes everywhere.

Defined results: a null text is empty; texts under ``LENGTH`` bytes lose
nothing; exact copies of ``LENGTH`` bytes or more lose all in all but the
smallest document; null ids count as larger than all others and equal among
themselves; rows with equal ids never repeat each other; an empty table gives
no rows; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import discard, equal_runs, releasing, releasing_group, row_chunks, stage_table, text_buffers
from sourceloom.llm.induced_sort import PackedText, equal_groups, suffix_order
from sourceloom.llm.words import SpanHasher, mix

LENGTH = 50
GRAM = 20
#: Bytes of text for each bucket of hashes, and of run bytes for each shard.
BUCKET_BYTES = 24 << 20
SHARD_BYTES = 3 << 20
#: Bytes of runs with one hash beyond which their windows are compared one by one.
HOT_BYTES = SHARD_BYTES
_LONGEST_RUN = 4096
#: Hashes that a task remembers as sent with two owners.
_TOLD = 1 << 16
_NULL_ID = (1 << 63) - 1

_RUN = np.dtype([("hash", "<u8"), ("row", "<u4"), ("start", "<u4"), ("size", "<u2")])
_SPAN = np.dtype([("start", "<i8"), ("count", "<i8")])


def window_runs(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Runs of windows that share their smallest hash: hash, text, first window, windows."""
    n, width = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, _RUN)
    at = np.arange(n - gram + 1)
    smallest, span = SpanHasher(data)(at, at + gram), 1
    while span * 2 <= width:
        smallest, span = np.minimum(smallest[:-span], smallest[span:]), span * 2
    if span < width:
        smallest = np.minimum(smallest[: len(smallest) - (width - span)], smallest[width - span :])
    text_of = np.repeat(np.arange(len(offs) - 1, dtype=np.uint32), np.diff(offs))
    inside = text_of[: n - length + 1] == text_of[length - 1 :]
    new = np.ones(len(smallest), bool)
    new[1:] = (smallest[1:] != smallest[:-1]) | (text_of[1 : len(smallest)] != text_of[: len(smallest) - 1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(smallest)))
    keep = inside[first]
    first, size = first[keep], size[keep]
    pieces = -(-size // _LONGEST_RUN)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, size = np.repeat(first, pieces) + nth * _LONGEST_RUN, np.repeat(size, pieces)
        size = np.minimum(size - nth * _LONGEST_RUN, _LONGEST_RUN)
    out = np.zeros(len(first), _RUN)
    out["hash"], out["row"], out["size"] = smallest[first], text_of[first], size
    out["start"] = first - offs[text_of[first].astype(np.int64)]
    return out


def _shared(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a hash that another owner has too; and two entries of each such hash, of its smallest and largest owner."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.lexsort((owner, hashes))
    at = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
    last = np.append(at[1:], len(hashes)) - 1
    many = owner[order[at]] != owner[order[last]]
    flags = np.zeros(len(hashes), bool)
    flags[order] = np.repeat(many, last - at + 1)
    return flags, order[np.concatenate([at[many], last[many]])]


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_PACKED = "part long, keys binary, records binary"


def _packed(keys: np.ndarray, records: np.ndarray, parts: int) -> pa.Table:
    """Records by a hash of their keys: one row for each part."""
    part = (mix(keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, keys, records = part[order], keys[order], records[order]
    groups = equal_runs(part)
    return pa.table({
        "part": pa.array([int(part[a]) for a, _ in groups], pa.int64()),
        "keys": pa.array([_blob(keys[a:b]) for a, b in groups], pa.binary()), "records": pa.array([_blob(records[a:b]) for a, b in groups], pa.binary()),
    })


def _gathered(packed: DataFrame, key: str, name: str, kind: np.dtype) -> DataFrame:
    """One row for each key, with all its records."""

    def gather(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("keys").to_pylist()])
        records = np.concatenate([np.frombuffer(x, kind) for x in table.column("records").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, raw, size = keys[order], records[order].tobytes(), kind.itemsize
        groups = equal_runs(keys)
        return pa.table({key: pa.array(keys[np.array([a for a, _ in groups], np.int64)], pa.int64()), name: pa.array([raw[a * size : b * size] for a, b in groups], pa.binary())})

    return packed.groupBy("part").applyInArrow(releasing_group(gather), f"{key} long, {name} binary")


def _repeated_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """doc, runs (packed) of runs whose hash several documents have; (doc, text) come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent_before = np.zeros(_TOLD, np.uint64)
        for number, batch in enumerate(batches):
            data, offs = text_buffers(batch.column("text"))
            doc = batch.column("doc").to_numpy()
            parts = []
            for i, j in row_chunks(offs):
                part = window_runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                part["row"] += np.uint32(i)
                parts.append(part)
            runs = np.concatenate(parts) if parts else np.zeros(0, _RUN)
            known, two = _shared(runs["hash"], doc[runs["row"]])
            slot = (mix(runs["hash"]) % np.uint64(_TOLD)).astype(np.int64)
            told = sent_before[slot] == runs["hash"]
            two, known = two[~told[two]], known | told
            sent = ~known
            sent[two] = True
            sent_before[slot[two]] = runs["hash"][two]
            bucket = (runs["hash"] >> np.uint64(32)).astype(np.int64) % buckets
            rows, names = [], []
            for flags, base in ((sent, 0), (known, buckets)):  # known to repeat: passed through, dealt by row
                own, place = runs[flags], bucket[flags] if base == 0 else base + (mix(runs["row"][flags].astype(np.uint64) + np.uint64(number)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                own, place = own[order], place[order]
                for a, b in equal_runs(place):
                    group = own[a:b]
                    present, compact = np.unique(group["row"], return_inverse=True)
                    group["row"] = compact
                    names.append(int(place[a]))
                    rows.append((_blob(doc[present]), _blob(group)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "docs", "runs"])

    def shared(table: pa.Table) -> pa.Table:
        docs, runs = [], []
        for d, r in zip(table.column("docs").to_pylist(), table.column("runs").to_pylist(), strict=True):
            part = np.frombuffer(r, _RUN)
            runs.append(part)
            docs.append(np.frombuffer(d, np.int64)[part["row"]])
        doc, run = np.concatenate(docs), np.concatenate(runs)  # a group has a row at least
        if table.column("bucket")[0].as_py() < buckets:
            keep, _ = _shared(run["hash"], doc)
            doc, run = doc[keep], run[keep]
        return _packed(doc, run, buckets)

    found = docs.mapInArrow(releasing(run), "bucket long, docs binary, runs binary")
    return _gathered(found.groupBy("bucket").applyInArrow(releasing_group(shared), _PACKED), "doc", "runs", _RUN)


def _hot_slots(texts: DataFrame, slots: int) -> np.ndarray:
    """Slots (hashes modulo ``slots``) whose runs have over ``HOT_BYTES``, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots)
        for batch in batches:
            data, offs = text_buffers(batch.column("runs"))
            own = np.frombuffer(data[offs[0] : offs[-1]].tobytes(), _RUN)
            total += np.bincount((own["hash"] % np.uint64(slots)).astype(np.int64), own["size"].astype(np.int64) + LENGTH - 1, slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64), pa.int64())], ["slot", "bytes"])

    sums = texts.select("runs").mapInArrow(releasing(run), "slot long, bytes long").groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    return np.array(sorted(r["slot"] for r in sums.filter(F.col("bytes") > HOT_BYTES).collect()), np.int64)  # at most one for each HOT_BYTES


def _own_runs(lists: pa.Array, i: int, j: int, offs: np.ndarray, slots: int, hot: np.ndarray, want_hot: bool) -> np.ndarray:
    """The runs of texts i to j that fit them, of hot slots or of all others."""
    parts = []
    for k in range(i, j):
        own = np.unique(np.frombuffer(lists[k].as_py(), _RUN)[["start", "size", "hash"]])
        own = own[own["start"].astype(np.int64) + own["size"] + LENGTH - 1 <= offs[k + 1] - offs[k]]
        part = np.zeros(len(own), _RUN)
        for name in ("start", "size", "hash"):
            part[name] = own[name]
        part["row"] = k
        parts.append(part)
    runs = np.concatenate(parts)
    if len(hot):
        return runs[np.isin((runs["hash"] % np.uint64(slots)).astype(np.int64), hot) == want_hot]
    return runs[:0] if want_hot else runs


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), _SPAN)
    out["start"], out["count"] = start, count
    return out


def _hot_windows(texts: DataFrame, slots: int, hot: np.ndarray) -> DataFrame:
    """key, doc, entries (pairs of rid and window) of the windows of hot runs.

    Of equal windows in a chunk those of the smallest document share a row; the
    others are settled, and have a null key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            rid, doc = batch.column("rid").to_numpy(), batch.column("doc").to_numpy()
            for i, j in row_chunks(offs):
                runs = _own_runs(batch.column("runs"), i, j, offs, slots, hot, True)
                if not len(runs):
                    continue
                chunk = data[offs[i] : offs[j]]
                count, row = runs["size"].astype(np.int64), runs["row"].astype(np.int64)
                at = np.repeat(offs[row] - offs[i] + runs["start"] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                row = np.repeat(row, count)
                content = SpanHasher(chunk)(at, at + LENGTH)
                order = np.lexsort((doc[row], content))
                at, row, content = at[order], row[order], content[order]
                new = np.concatenate([[True], content[1:] != content[:-1]])
                first = at[np.flatnonzero(new)][np.cumsum(new) - 1]
                eight = np.ndarray((len(chunk) - 7,), "<u8", np.ascontiguousarray(chunk), strides=(1,))  # from every byte
                same = np.logical_and.reduce([eight[at + k] == eight[first + k] for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]])
                if not same.all():  # other windows with one hash: each is a group of its own
                    by = np.argsort(~same, kind="stable")
                    at, row, new = at[by], row[by], new[by] | ~same[by]
                lead = np.flatnonzero(new)
                later = doc[row] > doc[row[lead]][np.cumsum(new) - 1]
                entries = np.stack([rid[row], at - (offs[row] - offs[i])], axis=1).astype(np.int64)
                if later.any():
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([0], pa.int64()), pa.array([_blob(entries[later])], pa.binary())], ["key", "doc", "entries"])
                size = np.add.reduceat(~later, lead, dtype=np.int64)
                entries, end = entries[~later], np.cumsum(size)
                for a in range(0, len(lead), 1 << 14):
                    own = slice(a, min(a + (1 << 14), len(lead)))
                    n, low = own.stop - a, int(end[a] - size[a])
                    keys = chunk[at[lead[own]][:, None] + np.arange(LENGTH)]
                    cuts = np.concatenate([[0], end[own] - low]).astype(np.int32) * np.int32(16)
                    yield pa.RecordBatch.from_arrays([
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * np.int32(LENGTH)).tobytes()), pa.py_buffer(_blob(keys))]),
                        pa.array(doc[row[lead[own]]], pa.int64()),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(_blob(entries[low : end[own.stop - 1]]))]),
                    ], ["key", "doc", "entries"])

    return texts.mapInArrow(releasing(run), "key binary, doc long, entries binary")


def _hot_flagged(found: DataFrame, shards: int) -> DataFrame:
    """Packed spans of the windows of ``_hot_windows`` that start in a smaller document too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("entries"))
            own = np.frombuffer(data[offs[0] : offs[-1]].tobytes(), np.int64).reshape(-1, 2)
            if not len(own):
                continue
            own = own[np.lexsort((own[:, 1], own[:, 0]))]
            new = np.flatnonzero(np.concatenate([[True], (own[1:, 0] != own[:-1, 0]) | (own[1:, 1] != own[:-1, 1] + 1)]))
            yield from _packed(own[new, 0], _spans(own[new, 1], np.diff(np.append(new, len(own)))), shards).to_batches()

    least = found.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").drop("most")
    later = found.join(least, "key").filter("doc > least").select("entries")  # null keys don't meet
    return later.union(found.filter("key IS NULL").select("entries")).mapInArrow(releasing(run), _PACKED)


def _flagged(texts: DataFrame, shards: int, slots: int, hot: np.ndarray) -> DataFrame:
    """Packed spans (first window and number, by rid) of windows that start in a smaller document too.

    ``texts`` has rid, doc, text and runs (packed); runs of hot slots are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            rid, doc = batch.column("rid").to_numpy(), batch.column("doc").to_numpy()
            lists = batch.column("runs")  # packed
            for i, j in row_chunks(offs, 4 << 20):
                runs = _own_runs(lists, i, j, offs, slots, hot, False)
                row = runs["row"].astype(np.int64)
                first = offs[row] + runs["start"] - offs[i]
                chunk = data[offs[i] : offs[j]]
                content = SpanHasher(chunk)(first, first + runs["size"] + (LENGTH - 1))
                order = np.lexsort((doc[row], content))
                same = np.concatenate([[False], content[order][1:] == content[order][:-1]]) if len(order) else np.zeros(0, bool)
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                alike = np.flatnonzero(same)  # by hash so far
                raw, stop = chunk.tobytes(), first + runs["size"] + (LENGTH - 1)
                pairs = (x[order[k]].tolist() for k in (alike, lead[alike]) for x in (first, stop))
                same[alike] = [raw[a:b] == raw[c:d] for a, b, c, d in zip(*pairs, strict=True)]
                later = same & (doc[row[order]] > doc[row[order[lead]]])  # the whole run starts in a smaller document
                settled = order[later]
                sent = order[~same]
                equal = order[same & ~later]  # same id: judged like the first of them
                sent = np.concatenate([sent, equal])
                shard = (runs["hash"][sent] % np.uint64(shards)).astype(np.int64)
                by = np.argsort(shard, kind="stable")
                sent, shard = sent[by], shard[by]
                names, metas, bodies = [], [], []
                for a, b in equal_runs(shard):
                    own = sent[a:b]
                    size = runs["size"][own].astype(np.int64) + LENGTH - 1
                    place = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    names.append(int(shard[a]))
                    metas.append(_blob(np.stack([rid[row[own]], doc[row[own]], runs["start"][own].astype(np.int64), size], axis=1)))
                    bodies.append(_blob(chunk[place]))
                if len(settled):
                    names.append(shards + int(rid[i]) % shards)
                    metas.append(_blob(np.stack([rid[row[settled]], doc[row[settled]], runs["start"][settled].astype(np.int64), runs["size"][settled].astype(np.int64)], axis=1)))
                    bodies.append(b"")
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(metas, pa.binary()), pa.array(bodies, pa.binary())], ["shard", "meta", "body"])

    def judge(table: pa.Table) -> pa.Table:
        meta = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("meta").to_pylist()]).reshape(-1, 4)
        if table.column("shard")[0].as_py() >= shards:
            return _packed(meta[:, 0], _spans(meta[:, 2], meta[:, 3]), shards)
        body = np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint8)
        rid, start, count = judge_runs(meta, body)
        return _packed(rid, _spans(start, count), shards)

    dealt = texts.mapInArrow(releasing(run), "shard long, meta binary, body binary")
    return dealt.groupBy("shard").applyInArrow(releasing_group(judge), _PACKED)


def judge_runs(meta: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, first window, windows) of windows of the runs that start in a smaller document too.

    ``meta`` has rid, doc, first window and bytes of each run; ``body`` their bytes.
    """
    size = meta[:, 3]
    starts = np.cumsum(size + 1) - (size + 1)
    # UTF-8 has no byte over 0xF7: all are shifted by one, and 0 stands between the runs
    text = np.zeros(int((size + 1).sum()), np.uint8)
    place = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    text[place] = body + np.uint8(1)
    windows = np.zeros(len(text), bool)
    count = size - (LENGTH - 1)
    at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
    windows[at] = True
    owner = np.repeat(np.arange(len(meta)), count)
    owner_of = np.full(len(text), -1, np.int64)
    owner_of[at] = owner
    packed = PackedText(text)
    order = suffix_order(text, LENGTH, packed)
    order = order[windows[order]]
    group = equal_groups(text, order, LENGTH, packed)
    doc = meta[owner_of[order], 1]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(doc, first) if len(first) else doc
    flagged = np.sort(order[doc > least[group]])
    new = np.flatnonzero(np.concatenate([[True], (flagged[1:] != flagged[:-1] + 1) | (owner_of[flagged[1:]] != owner_of[flagged[:-1]])])) if len(flagged) else np.zeros(0, np.int64)
    run = owner_of[flagged[new]]
    return meta[run, 0], meta[run, 2] + flagged[new] - starts[run], np.diff(np.append(new, len(flagged)))


def covered(pairs: np.ndarray, size: int) -> np.ndarray:
    """Flags of the bytes that the flagged windows cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 0] + pairs[:, 1] + LENGTH - 1, -1)
    return np.cumsum(edge[:-1]) > 0


_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; kept (binary) if asked."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    light = rows.select("doc", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    light = stage_table(light, "repeat-rows")
    total = light.agg(F.sum("n_bytes")).first()[0] or 0
    firsts = light.filter(F.col("n_bytes") >= LENGTH).groupBy("key").agg(F.min("doc").alias("first"))

    runs = stage_table(_repeated_runs(rows.select("doc", "text"), max(4, -(-total // BUCKET_BYTES))), "repeat-runs")
    run_bytes = runs.agg(F.sum(F.octet_length("runs"))).first()[0] or 0
    shards = max(4, -(-(run_bytes // _RUN.itemsize * 67) // SHARD_BYTES))
    wanted = runs.join(firsts.withColumnRenamed("first", "doc"), "doc")  # of equal texts only the first
    texts = rows.join(wanted, ["key", "doc"])
    texts = stage_table(texts.dropDuplicates(["key", "doc"]).withColumn("rid", F.monotonically_increasing_id()), "repeat-texts")

    discard(runs)
    own, slots = texts.select("rid", "doc", "text", "runs"), 32 * shards
    hot = _hot_slots(texts, slots)
    flagged, windows = _flagged(own, shards, slots, hot), []
    if len(hot):
        windows.append(stage_table(_hot_windows(own, slots, hot), "repeat-hot"))
        flagged = flagged.union(_hot_flagged(windows[0], shards))
    spans = stage_table(_gathered(flagged, "rid", "spans", _SPAN), "repeat-spans")
    discard(*windows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            removed, number, shas, kept = [], [], [], []
            for k, flagged in enumerate(batch.column("spans")):
                own = data[offs[k] : offs[k + 1]]
                gone = covered(np.frombuffer(flagged.as_buffer(), np.int64).reshape(-1, 2), len(own))
                left = own[~gone].tobytes()
                removed.append(int(gone.sum()))
                number.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], ["doc", "key", "n_removed", "n_spans", "kept_sha", "kept"])

    partly = texts.select("rid", "doc", "key", "text").join(spans, "rid").select("doc", "key", "text", "spans").mapInArrow(releasing(cut), "doc long, key binary, n_removed long, n_spans long, kept_sha string, kept binary")
    partly = stage_table(partly, "repeat-cut")
    discard(texts, spans)
    copy = F.col("first").isNotNull() & (F.col("doc") > F.col("first"))
    out = light.join(firsts, "key", "left").join(partly, ["key", "doc"], "left")
    return out.select(
        F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    )
