"""Token ids in keyed binary shards.

Documents are dealt by ranges of doc_id, encoded, and written to shards.  A
shard holds a minimal perfect hash of its document keys with a fingerprint per
slot, so that a key's ids are found in constant time, and the raw ids.  A small
table beside the shards leads from a key to the files that can hold it.

Encoding: a text is cut at white space and, inside plain chunks (ASCII and
Latin-1 letters, digits, marks, without apostrophes or special tokens), where
the tokenizer's own pattern always cuts; equal segments are encoded once by the
tokenizers library and remembered by their bytes: segments of under 16 bytes
are two numbers that hold them whole, longer ones are looked up as they are.
Other chunks are encoded whole.  All of this leaves every text's ids as they
are for the whole text.

Layout of a shard, little endian: magic, 8 int64 counts, then sections: words of
the hash levels, their bits and ranks, fingerprints, row of each slot, offsets
of rows, keys of rows, null flags, ids; and a crc32 of all before it.

Defined results: null and empty texts are the end id alone; null ids come
first; rows with one id are in the order of their text's first characters, its
hash and the text, so that a frequent id, or the null id, may fill many shards;
the index of a shard leads to its first row of a key; an empty table gives no
rows; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceloom.llm import perfect_hash
from sourceloom.llm.common import releasing, row_chunks, stage_table, text_buffers
from sourceloom.llm.raw_files import read_raw, write_raw
from sourceloom.llm.words import mix, runs

END_ID = 2
#: Bytes of text for one partition of documents, and ids after which a new shard begins.
PARTITION_BYTES = 32 << 20
SHARD_IDS = 1 << 22
#: Ids that a worker remembers at most for segments it has met, and bytes of long segments.
POOL_IDS = 1 << 21
LONG_BYTES = 4 << 20
#: Leading characters of a text that deal rows with one id to shards, before its hash.
DEAL_CHARS = 64
MAGIC = b"IDSHARD2"
SEPARATOR = "\n"
INDEX = "_index"

_B = np.arange(256)
_SPACE = np.isin(_B, [9, 10, 11, 12, 13, 32])
_KIND = np.full(256, 3, np.uint8)  # other ASCII
_KIND[_SPACE] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[39] = 4
_KIND[128:] = 4
_SLOTS_BITS = 18
#: Bytes of a segment that fit two numbers, beside its length.
_SHORT = 15
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_encoders: dict[str, SegmentEncoder] = {}


class SegmentEncoder:
    """Encodes texts with a tokenizer that drops white space and marks word ends."""

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.wide = size > 1 << 16
        self.is_end = np.zeros(size, bool)
        suffix = self.tokenizer.model.end_of_word_suffix
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.is_end[number] = token.endswith(suffix)
        self._reset()

    def _reset(self) -> None:
        n = 1 << _SLOTS_BITS
        self.low, self.high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.start, self.length = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0
        self.long: dict[bytes, tuple[int, int]] = {}
        self.long_bytes = 0

    def _store(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _encode_plain(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pool starts and lengths of segments that are one piece each."""
        joined = [" ".join(segments[i : i + 512]) for i in range(0, len(segments), 512)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(segments):
            return self._encode_any(segments)
        base = self._store(ids)
        starts = np.concatenate([[0], ends[:-1]])
        return starts + base, ends - starts

    def _encode_any(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        length = np.array([len(x) for x in each])
        base = self._store(np.array([i for x in each for i in x], np.uint32))
        return np.cumsum(length) - length + base, length

    def _encode_new(self, segments: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pool starts and lengths of distinct segments."""
        texts = [x.decode("utf-8", "replace") for x in segments]
        start, length = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for which, encode in ((plain, self._encode_plain), (~plain, self._encode_any)):
            at = np.flatnonzero(which)
            if len(at):
                start[at], length[at] = encode([texts[i] for i in at])
        return start, length

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the texts; no end ids."""
        if self.used > POOL_IDS or self.long_bytes > LONG_BYTES:
            self._reset()
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
        tail = data[lead + 1]
        lead = lead[(tail >= 0x80) & (tail != 0x97) & (tail != 0xB7)]  # the Latin-1 letters
        kind[lead] = kind[lead + 1] = 1
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        upper = lead + 1
        upper = upper[data[upper] <= 0x9E]
        low[upper] += 32
        chunk_start, chunk_end = runs(kind > 0, offs)
        odd = kind == 4
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # "<|" may open a special token
        odd_total = np.concatenate([[0], np.cumsum(odd)])
        is_odd = odd_total[chunk_end] > odd_total[chunk_start]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[chunk_start[is_odd]] += 1
        edge[chunk_end[is_odd]] -= 1
        whole = np.cumsum(edge[:-1], dtype=np.int8) > 0
        low[whole] = data[whole]
        begin = np.zeros(len(data), bool)
        begin[1:] = (kind[1:] > 0) & ~whole[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        begin[chunk_start] = True
        start = np.flatnonzero(begin)
        chunk = np.searchsorted(chunk_start, start, side="right") - 1
        end = np.minimum(np.append(start[1:], len(data)), chunk_end[chunk]) if len(start) else start
        size = end - start
        short = size <= _SHORT
        eight = np.ndarray((len(low) + 9,), "<u8", np.concatenate([low, np.zeros(16, np.uint8)]), strides=(1,))  # from every byte
        # the bytes and their number: equal numbers are equal segments
        one = eight[start] & _MASKS[np.minimum(size, 8)]
        two = (eight[start + np.minimum(size, 8)] & _MASKS[np.clip(size - 8, 0, 7)]) | (size.astype(np.uint64) << np.uint64(56))
        slot = (mix(one ^ mix(two)) >> np.uint64(64 - _SLOTS_BITS)).astype(np.int64)
        pool_start, length = self.start[slot].astype(np.int64), self.length[slot].astype(np.int64)
        miss = np.flatnonzero(short & ((self.low[slot] != one) | (self.high[slot] != two)))
        if len(miss):
            order = np.lexsort((one[miss], two[miss]))
            a, b = one[miss][order], two[miss][order]
            fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            new = miss[order[fresh]]
            new_start, new_length = self._encode_new([low[i:j].tobytes() for i, j in zip(start[new].tolist(), end[new].tolist(), strict=True)], ~is_odd[chunk[new]])
            s, at = np.unique(slot[new], return_index=True)
            self.low[s], self.high[s], self.start[s], self.length[s] = one[new[at]], two[new[at]], new_start[at], new_length[at]
            group = np.empty(len(miss), np.int64)
            group[order] = np.cumsum(fresh) - 1
            pool_start[miss], length[miss] = new_start[group], new_length[group]
        long = np.flatnonzero(~short)
        if len(long):
            found = [low[i:j].tobytes() for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True)]
            missing: dict[bytes, int] = {}
            for place, segment in enumerate(found):
                if segment not in self.long:
                    missing.setdefault(segment, place)
            if missing:
                new_start, new_length = self._encode_new(list(missing), ~is_odd[chunk[long[list(missing.values())]]])
                self.long.update(zip(missing, zip(new_start.tolist(), new_length.tolist(), strict=True), strict=True))
                self.long_bytes += sum(len(x) + 128 for x in missing)
            pool_start[long], length[long] = np.array([self.long[x] for x in found], np.int64).T
        out_end = np.cumsum(length)
        ids = self.pool[np.repeat(pool_start - (out_end - length), length) + np.arange(out_end[-1] if len(out_end) else 0)]
        return ids, np.concatenate([[0], out_end])[np.searchsorted(start, offs)]


def encoder_of(tokenizer_json: str) -> SegmentEncoder:
    """The encoder of this worker process; what it remembers serves all its tasks."""
    if tokenizer_json not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_json] = SegmentEncoder(tokenizer_json)
    return _encoders[tokenizer_json]


def pack_shard(keys: np.ndarray, null: np.ndarray, offsets: np.ndarray, ids: np.ndarray, order: tuple[int, int]) -> bytes:
    """The bytes of a shard; rows are in ascending key order."""
    row = np.flatnonzero(~null & np.concatenate([[True], (keys[1:] != keys[:-1]) | null[:-1]]))
    distinct = keys[row].view(np.uint64)
    levels = perfect_hash.build_levels(distinct)
    slot = perfect_hash.slots(levels, distinct)
    mark, row_of = np.zeros(len(row), np.uint32), np.zeros(len(row), np.uint32)
    mark[slot], row_of[slot] = perfect_hash.fingerprint(distinct), row
    width = ids.dtype.itemsize
    counts = np.array([width, len(keys), len(row), len(ids), len(levels), *order, 0], np.int64)
    bits = [x.tobytes() for level in levels for x in level]
    parts = [MAGIC, counts.tobytes(), np.array([len(x.words) for x in levels], np.int64).tobytes(), *bits, mark.tobytes(), row_of.tobytes(), offsets.astype(np.int64).tobytes(), keys.tobytes(), null.astype(np.uint8).tobytes(), ids.tobytes()]
    body = b"".join(parts)
    return body + zlib.crc32(body).to_bytes(4, "little")


class Shard:
    """A shard in memory."""

    def __init__(self, raw: memoryview) -> None:
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a shard")
        self.at = 8

        def take(kind: type, n: int) -> np.ndarray:
            out = np.frombuffer(raw, kind, n, self.at)
            self.at += out.nbytes
            return out

        width, self.rows, n, n_ids, n_levels, part, number, _ = take(np.int64, 8).tolist()
        self.order = (part, number)
        self.levels = [perfect_hash.Level(take(np.uint64, size), take(np.uint32, size)) for size in take(np.int64, n_levels).tolist()]
        self.mark, self.row_of = take(np.uint32, n), take(np.uint32, n)
        self.offsets, self.keys = take(np.int64, self.rows + 1), take(np.int64, self.rows)
        self.null = take(np.uint8, self.rows).astype(bool)
        self.ids = take(np.uint16 if width == 2 else np.uint32, n_ids)
        if zlib.crc32(raw[: self.at]) != int.from_bytes(raw[self.at : self.at + 4], "little"):
            raise ValueError("the shard is damaged")
        self.size = self.at + 4

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key; -1 for keys that aren't here."""
        keys = keys.view(np.uint64)
        slot = perfect_hash.slots(self.levels, keys)
        known = slot >= 0
        known[known] = self.mark[slot[known]] == perfect_hash.fingerprint(keys[known])
        out = np.full(len(keys), -1, np.int64)
        out[known] = self.row_of[slot[known]]
        return out

    def rows_by_key(self) -> np.ndarray:
        """Row of each document, found through the index: the first of its key, and those with the same key after it."""
        full = np.flatnonzero(~self.null)
        keys, row = self.keys[full], np.arange(self.rows)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
        first = self.find(keys[new])
        if (first < 0).any() or (self.keys[first] != keys[new]).any():
            raise ValueError("the index misses a key")
        at = np.arange(len(keys))
        row[full] = first[np.cumsum(new) - 1] + at - np.maximum.accumulate(np.where(new, at, 0))
        return row

    def ids_of(self, key: int) -> list[np.ndarray]:
        """The ids of every row with this key."""
        row = int(self.find(np.array([key], np.int64))[0])
        out = []
        while 0 <= row < self.rows and not self.null[row] and self.keys[row] == key:
            out.append(self.ids[self.offsets[row] : self.offsets[row + 1]])
            row += 1
        return out


def shards_of(content: bytes | memoryview) -> Iterator[Shard]:
    """The shards of a file."""
    raw, at = memoryview(content).cast("B"), 0
    while at < len(raw):
        shard = Shard(raw[at:])
        yield shard
        at += shard.size + len(SEPARATOR)


def write_shards(docs: DataFrame, tokenizer_json: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Encode and write all documents; the folder of the shards."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(held.value)
        kind = np.uint32 if encoder.wide else np.uint16
        part, number = TaskContext.get().partitionId(), 0
        keys: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held_ids = 0

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            block = pack_shard(np.concatenate(keys), np.concatenate(nulls), offsets, np.concatenate(ids), (part, number))
            for x in (keys, nulls, lengths, ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            doc_id = batch.column("doc_id")
            null = doc_id.is_null().to_numpy(zero_copy_only=False)
            key = doc_id.fill_null(0).to_numpy()
            for i, j in row_chunks(offs):
                got, cut = encoder.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                size = np.diff(cut)
                full = np.full(len(got) + j - i, end_id, kind)
                place = np.ones(len(full), bool)
                place[np.cumsum(size + 1) - 1] = False
                full[place] = got
                keys.append(key[i:j])
                nulls.append(null[i:j])
                lengths.append(size + 1)
                ids.append(full)
                held_ids += len(full)
                if held_ids >= SHARD_IDS:
                    yield flush()
                    number, held_ids = number + 1, 0
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    default = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, DEAL_CHARS), F.xxhash64("text")]
    dealt = rows.repartitionByRange(max(default, -(-size // PARTITION_BYTES)), *order, F.monotonically_increasing_id()).sortWithinPartitions(*order, "text")
    return write_raw(dealt.mapInArrow(releasing(run), "block binary"), "token-shards", SEPARATOR, path)


def write_index(spark: SparkSession, path: str) -> None:
    """Write the table that leads from keys to files: file, shard, first_key, last_key, rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                for shard in shards_of(content.as_buffer()):
                    keys = shard.keys[~shard.null]
                    ends = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file, shard.order[1], *ends, shard.rows), (pa.string(), *[pa.int64()] * 4), strict=True)], ["file", "shard", "first_key", "last_key", "rows"])

    read_raw(spark, path, file="file").mapInArrow(releasing(run), "file string, shard long, first_key long, last_key long, rows long").write.parquet(f"{path}/{INDEX}")


def lookup(spark: SparkSession, path: str, keys: Sequence[int]) -> DataFrame:
    """doc_id, ids of the rows with one of some keys; only the files whose key range holds a key are read."""
    wanted = sorted(set(keys))
    index = spark.read.parquet(f"{path}/{INDEX}")
    fits = F.lit(False)
    for key in wanted:
        fits = fits | ((F.col("first_key") <= key) & (F.col("last_key") >= key))
    files = [r["file"] for r in index.filter(fits).select("file").distinct().collect()]  # those that may hold the keys asked for

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for shard in shards_of(content.as_buffer()):
                    found = [(k, ids.astype(np.int64)) for k in wanted for ids in shard.ids_of(k)]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    schema = "doc_id long, ids array<long>"
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(releasing(run), schema)


def read_shards(docs_path: str, spark) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for shard in shards_of(content.as_buffer()):
                    row, ids, n = shard.rows_by_key(), shard.ids.astype("<u4"), shard.rows
                    first, last = shard.offsets[row], shard.offsets[row + 1]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.keys, mask=shard.null), pa.array(first), pa.array(last - first), pa.array(crc, pa.int64()),
                        pa.array(np.full(n, shard.order[0])), pa.array(np.full(n, shard.order[1])), pa.array(np.full(n, len(ids))),
                    ], ["doc_id", "at", "n_tokens", "ids_crc32", "part", "number", "shard_ids"])

    schema = "doc_id long, at long, n_tokens long, ids_crc32 long, part long, number long, shard_ids long"
    rows = stage_table(read_raw(spark, docs_path).mapInArrow(releasing(run), schema), "token-rows")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = rows.groupBy("part", "number").agg(F.max("shard_ids").alias("n")).select("part", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(shards, ["part", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
