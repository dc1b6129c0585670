"""WARC archives in Zstandard, one frame per record, with a shared dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a Zstandard frame; each record is a frame of its own.  The
writer separates records by empty skippable frames, which any reader passes over.

Records whose payloads are equal and long enough refer to one of them: that of
the largest page id is a response with the payload, the others are revisits.

Defined results: a null html is an empty payload; a null url has no target
header; a null page id takes no part in revisits and comes back as null; rows
that repeat the largest page id of their payload are all responses; an empty
table makes archives without records; only the id, url and html columns are
read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import discard, releasing, stage_table
from sourceloom.llm.raw_files import read_raw, write_raw

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame, in ASCII.
SEPARATOR = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
MIN_REVISIT_BYTES = 1000
#: Payload bytes of an archive, about.
ARCHIVE_BYTES = 64 << 20
#: Bounds of the dictionary: pages it is trained on, their leading characters, and its bytes.
DICTIONARY_PAGES, DICTIONARY_CHARS = 200, 1 << 15
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response, or with ``refers_to`` a revisit, whose block has HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def _headers(raw: bytes) -> tuple[bytes, dict[str, str]]:
    first, *lines = raw.split(b"\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"not a header: {line[:40]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return first, out


def decode_record(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, type, refers_to) of a valid record."""
    head, found, rest = record.partition(_END)
    version, headers = _headers(head)
    if not found or version != b"WARC/1.1":
        raise ValueError("not a WARC record")
    length = int(headers["content-length"])
    if len(rest) != length + len(_END) or not rest.endswith(_END):
        raise ValueError("Content-Length is wrong")
    http, found, payload = rest[:length].partition(_END)
    status, http_headers = _headers(http)
    if not found or not status.startswith(b"HTTP/1.1 "):
        raise ValueError("not an HTTP response")
    algorithm, _, code = headers["warc-payload-digest"].partition(":")
    digest, size = base64.b32decode(code).hex(), int(http_headers["content-length"])
    kind, own = headers["warc-type"], headers["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    if algorithm != "sha1" or kind not in ("response", "revisit"):
        raise ValueError("unknown digest or record type")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload is not what its headers say")
    if kind == "revisit" and payload:
        raise ValueError("a revisit has a payload")
    refers = headers["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">") if kind == "revisit" else ""
    return int(own) if own else None, size, digest, kind, int(refers) if refers else None


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded number of pages; empty if there are too few."""
    head = F.substring(F.col("html").cast("string"), 1, DICTIONARY_CHARS)
    sample = [r[0].encode() for r in pages.select(head).filter("html IS NOT NULL").limit(DICTIONARY_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [encode_record(0, None, x, "00" * 20, len(x), None) for x in sample]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def write_archives(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write all pages; the folder of the archives.

    Which pages refer to which is decided on ids and digests alone; the payloads
    then move once, to archives of about ``archive_bytes``, by page and digest.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    narrow = stage_table(rows.select("page_id", "digest", "size"), "page-digests")
    long = narrow.filter((F.col("size") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull())
    top = long.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("other")).filter("other < refers_to").drop("other")
    revisits = long.join(top, ["digest", "size"]).filter("page_id < refers_to").select(F.col("page_id").alias("deal"), "digest", "refers_to").distinct()
    default = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # with fewer, the join would deal all payloads again
    archives = max(default, -(-(narrow.agg(F.sum("size")).first()[0] or 0) // archive_bytes))
    dealt = rows.withColumn("deal", F.coalesce("page_id", F.xxhash64("url", "digest"))).repartition(archives, "deal", "digest")
    decided = dealt.join(revisits.repartition(archives, "deal", "digest").hint("shuffle_hash"), ["deal", "digest"], "left")
    decided = decided.withColumn("refers_to", F.when(F.col("page_id").isNotNull(), F.col("refers_to")))
    decided = decided.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest", "size", "refers_to")
    dictionary = train_dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
        first = True
        for batch in batches:
            frames = [compressor.compress(encode_record(*row)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if first and trained:
                frames.insert(0, _skippable(DICTIONARY_MAGIC, zstandard.ZstdCompressor(level=19).compress(dictionary)))
            first = False
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    path = write_raw(decided.mapInArrow(releasing(run), "frame binary"), "warc", SEPARATOR, path)
    discard(narrow)
    return path


def frame_end(raw: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends."""
    p = zstandard.get_frame_parameters(raw[at : at + 18])
    place = at + zstandard.frame_header_size(raw[at : at + 18])
    last = 0
    while not last:
        head = int.from_bytes(raw[place : place + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        place += 3 + (1 if kind == 1 else size)
    return place + 4 * p.has_checksum


def read_records(content: bytes | memoryview) -> Iterator[bytes]:
    """The records of one archive."""
    raw, at, leading, dictionary = memoryview(content).cast("B"), 0, True, None
    decompressor = zstandard.ZstdDecompressor()
    while at < len(raw):
        magic = int.from_bytes(raw[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(raw[at + 4 : at + 8], "little")
            body = raw[at + 8 : at + 8 + size]
            if len(body) != size:
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC and leading:
                held = zstandard.ZstdDecompressor().decompress(bytes(body)) if body[:4] == b"\x28\xb5\x2f\xfd" else bytes(body)
                dictionary = zstandard.ZstdCompressionDict(held)
                decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
            at += 8 + size
        else:
            end = frame_end(raw, at)
            yield decompressor.decompress(raw[at:end])
            at = end
        leading = False


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of a folder of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [decode_record(r) for r in read_records(content.as_buffer())]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read_raw(spark, path).mapInArrow(releasing(run), SCHEMA)
