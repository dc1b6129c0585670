"""Language identification by hyperdimensional profiles.

Every letter (and the blank between words) has a random vector of ``BITS`` signs, made
from a hash of its code point.  The vector of an n-gram binds those of its letters:
each is rotated by its place and they are multiplied, which in bits is exclusive or.
A text's vector is the sum over its n-grams (bundling), a language's prototype the sum
over the vectors of its texts, and a text gets the language whose prototype has the
largest cosine with it.  What all languages share is taken away first: the mean of the
prototypes' directions is subtracted from them and, in its share, from the text.

N-grams are counted on bounded chunks of code points; only a chunk's distinct ones are
bound, and texts are bundled by a product of counts with their vectors.  A long text is
cut into pieces whose sums are added, so memory doesn't grow with its length.
Prototypes are sums over all learnable documents, added up by Spark by language and
block of coordinates; the driver gets ``BITS`` numbers for each language, and at most
``MAX_LANGUAGES`` of those (more of them aren't languages: an error).

Defined results: null texts and texts without a letter are ``und`` with score 0, and so
is every text if nothing could be learned; a tie goes to the smallest language; rows
without an id or a language are predicted but not learned from; repeated rows are
separate documents; an empty table gives no rows; columns are read by name, so others
can't clash.  The score is the cosine, cut at 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import releasing, row_chunks, text_buffers
from sourceloom.llm.words import mix

BITS = 1024
N = 3
MAX_LANGUAGES = 8192
UND = "und"
#: Bytes of a piece of text, and n-grams that are bound at a time.
PIECE_BYTES = 1 << 19
BOUND_AT_A_TIME = 1024
#: Coordinates that are summed in one row.
BLOCK = 64

_WORDS = BITS // 64
_letters: list[np.ndarray] = []


def lowered() -> np.ndarray:
    """The lower-case form of every code point that is a letter, 0 of the others; made once in a process."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the documents, which are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """Random bits of each code point, 64 to a number."""
    return mix(mix(points.astype(np.uint64) + np.uint64(1))[:, None] + np.arange(_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bound(grams: np.ndarray) -> np.ndarray:
    """Bits (0 or 1) of n-grams, given as numbers of 21 bits for each letter."""
    out = np.zeros((len(grams), _WORDS), np.uint64)
    for place in range(N):
        letters = (grams >> np.uint64(21 * (N - 1 - place))) & np.uint64(0x1FFFFF)
        out ^= np.roll(letter_vectors(letters), N - 1 - place, axis=1)
    return np.unpackbits(out.view(np.uint8), axis=1)


def pieces(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool, bool]]:
    """(first text, last text, bytes, offsets, before, after): the texts together, or where one is long, each piece by piece.

    A piece has a character more on either side where the text goes on (``before``,
    ``after``), whose own n-grams are those of the piece next to it.
    """
    if len(offs) < 2 or np.diff(offs).max() <= PIECE_BYTES:
        yield 0, len(offs) - 1, data, offs, False, False
        return

    def back(at: int, low: int) -> int:
        while at > low and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    for row, (low, high) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        a = low
        while a < high or a == low:
            b = high if high - a <= PIECE_BYTES else back(a + PIECE_BYTES, a)
            b = high if b == a else b
            left = back(a - 1, low) if a > low else a
            right = b + 1 if b < high else b
            while right < high and data[right] & 0xC0 == 0x80:
                right += 1
            yield row, row + 1, data[left:right], np.array([0, right - left]), a > low, b < high
            a = b
            if a == high:
                break


def gram_counts(data: np.ndarray, offs: np.ndarray, before: bool = False, after: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts as numbers; and the text, n-gram (its place) and count of all that occur in each text.

    Letters are lower-cased and each other character is a blank; an n-gram has a
    letter in its middle, and never spans two texts.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[offs]
    if first[-1] != len(points):  # not UTF-8: text by text, so that places are right
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        points, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    n_texts = len(first) - 1
    padded = np.zeros(len(points) + 2 * n_texts, np.uint32)  # a blank before and after each text
    padded[np.arange(len(points)) + 2 * np.repeat(np.arange(n_texts), np.diff(first)) + 1] = lowered()[points]
    middle = np.flatnonzero(padded)
    middle = middle[(middle > 1 if before else middle > 0) & (middle < len(padded) - 1 - after)]
    owner = np.searchsorted(first + 2 * np.arange(n_texts + 1), middle, side="right") - 1
    code = np.zeros(len(middle), np.uint64)
    for place in (-1, 0, 1):
        code = code << np.uint64(21) | padded[middle + place].astype(np.uint64)
    grams, at = np.unique(code, return_inverse=True)
    keys, counts = np.unique(owner * max(1, len(grams)) + at, return_counts=True)
    texts, places = np.divmod(keys, max(1, len(grams)))
    return grams, texts, places, counts


def bundled(grams: np.ndarray, owner: np.ndarray, places: np.ndarray, counts: np.ndarray, n: int, kind: type = np.float64) -> np.ndarray:
    """Sums of the n-grams' vectors for each of ``n`` owners; exact while counts stay below the floats' whole numbers."""
    out, total = np.zeros((n, BITS)), np.bincount(owner, counts, n)
    order = np.argsort(places, kind="stable")
    owner, places, counts = owner[order], places[order], counts[order]
    for a in range(0, len(grams), BOUND_AT_A_TIME):
        lo, hi = np.searchsorted(places, [a, a + BOUND_AT_A_TIME])
        bits = bound(grams[a : a + BOUND_AT_A_TIME]).astype(kind)
        rows, at = np.unique(owner[lo:hi], return_inverse=True)
        for b in range(0, len(rows), 512):  # owners at a time
            own = (at >= b) & (at < b + 512)
            matrix = np.zeros((len(rows[b : b + 512]), len(bits)), kind)
            matrix[at[own] - b, places[lo:hi][own] - a] = counts[lo:hi][own]
            out[rows[b : b + 512]] += matrix @ bits
    return 2 * out - total[:, None]


def text_vectors(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The vector of each text."""
    out = np.zeros((len(offs) - 1, BITS))
    for a, b, part, bounds, before, after in pieces(data, offs):
        grams, texts, places, counts = gram_counts(part, bounds, before, after)
        out[a:b] += bundled(grams, texts, places, counts, b - a, np.float32)
    return out


def merged(grams: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, and the owner, n-gram (its place) and total count of each pair of (n-gram, owner, count)."""
    names, at = np.unique(grams, return_inverse=True)
    keys, inverse = np.unique(owner * max(1, len(names)) + at, return_inverse=True)
    owner, places = np.divmod(keys, max(1, len(names)))
    return names, owner, places, np.bincount(inverse, counts, len(keys))


class Prototypes:
    """Directions of the languages, and their mean."""

    def __init__(self, names: list[str], sums: np.ndarray) -> None:
        self.names = names
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        unit = sums / np.where(norms > 0, norms, 1)
        self.mean = unit.mean(axis=0) if len(unit) > 1 else np.zeros(BITS)
        apart = unit - self.mean
        norms = np.linalg.norm(apart, axis=1, keepdims=True)
        self.unit = apart / np.where(norms > 0, norms, 1)

    def cosines(self, vectors: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        apart = vectors / np.where(norms > 0, norms, 1) - self.mean
        norms = np.linalg.norm(apart, axis=1, keepdims=True)
        return (apart / np.where(norms > 0, norms, 1)) @ self.unit.T


def fit(docs: DataFrame) -> Prototypes:
    """Prototypes of all languages, from every document that isn't held out."""
    rows = docs.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            coded = batch.column("lang").dictionary_encode()
            owner, k = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            seen = merged(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
            for i, j in row_chunks(offs):
                for a, b, part, bounds, before, after in pieces(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                    grams, texts, places, counts = gram_counts(part, bounds, before, after)
                    seen = merged(np.concatenate([seen[0][seen[2]], grams[places]]), np.concatenate([seen[1], owner[i + a : i + b][texts]]), np.concatenate([seen[3], counts]))
            total = bundled(*seen, k)
            blocks = BITS // BLOCK
            names = coded.dictionary.take(pa.array(np.repeat(np.arange(k), blocks)))
            values = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel().astype(np.int64)), BLOCK).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(blocks, dtype=np.int32), k)), values], ["lang", "block", "v"])

    parts = rows.mapInArrow(releasing(run), "lang string, block int, v array<long>")
    summed = parts.groupBy("lang", "block").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(BLOCK)]).alias("v"))
    found = summed.limit((MAX_LANGUAGES + 1) * (BITS // BLOCK)).toArrow()
    names = sorted(set(found.column("lang").to_pylist()), key=lambda x: x.encode())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sums = np.zeros((len(names), BITS))
    place = {x: i for i, x in enumerate(names)}
    for lang, block, v in zip(*(found.column(c).to_pylist() for c in ("lang", "block", "v")), strict=True):
        sums[place[lang], block * BLOCK : (block + 1) * BLOCK] = v
    return Prototypes(names, sums)


def predict(docs: DataFrame, model: Prototypes) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES x BITS numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = pa.array([*model.names, UND])
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            best, score = np.full(batch.num_rows, len(model.names)), np.zeros(batch.num_rows)
            for i, j in row_chunks(offs) if model.names else ():
                vectors = text_vectors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                some = vectors.any(axis=1)
                near = model.cosines(vectors[some])
                best[i:j][some], score[i:j][some] = near.argmax(axis=1), near.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names.take(pa.array(best)), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])

    found = rows.mapInArrow(releasing(run), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
