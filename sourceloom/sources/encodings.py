"""The encoding of bytes that aren't UTF-8 and have no mark: likelihoods of pairs of letters.

Bytes are read under each encoding, and the classes of neighbouring letters (ASCII or
not, lower or upper case, kana, other script) are looked up in a table of how likely
such a pair is in text of the encoding's script.  The products of these make a
probability for each encoding; the best one holds if it has ``CONFIDENCE`` and the
text ``LEAST_BYTES``.  Else Latin-1 does, which can read anything.
"""

from __future__ import annotations

import codecs
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sourceloom.session import ship_package

CONFIDENCE, LEAST_BYTES, SAMPLE_BYTES = 0.80, 128, 32768
FALLBACK = "iso-8859-1"
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))

#: How likely pairs of classes are by script: a ASCII letter, s other ASCII, l and u
#: letters of the script by case, k kana, j ideographs; what isn't named is unlikely.
_PAIRS = {
    "latin": {"al": 0.35, "la": 0.35, "ul": 0.01, "ll": 0.02, "sl": 0.1, "ls": 0.12, "su": 0.04, "ua": 0.05, "us": 0.01},
    "cyrillic": {"ll": 0.6, "ul": 0.06, "uu": 0.03, "sl": 0.1, "ls": 0.12, "su": 0.04, "us": 0.01, "lu": 0.002, "al": 0.002, "la": 0.002},
    "japanese": {"kk": 0.35, "kj": 0.12, "jk": 0.12, "jj": 0.15, "sk": 0.05, "ks": 0.05, "sj": 0.05, "js": 0.05, "pk": 0.02, "kp": 0.02, "pj": 0.02, "jp": 0.02, "ps": 0.01, "sp": 0.01},
}
_UNLIKELY = 0.0005
ENCODINGS = {FALLBACK: "latin", "koi8-r": "cyrillic", "windows-1251": "cyrillic", "shift_jis": "japanese", "euc_jp": "japanese"}


def _class(c: str) -> str:
    if c < "\x80":
        return "a" if c.isalpha() else "s"
    if "぀" <= c <= "ヿ":
        return "k"
    if "一" <= c <= "鿿":
        return "j"
    if "　" <= c <= "〿":
        return "p"
    if "｡" <= c <= "ﾟ":
        return "h"  # half-width kana: what single bytes of other encodings look like
    return {"Ll": "l", "Lu": "u"}.get(unicodedata.category(c), "x")


class _Classes(dict):
    """Classes by code point, each told once."""

    def __missing__(self, code: int) -> str:
        self[code] = out = _class(chr(code))
        return out


_CLASSES = _Classes()
_LOGS = {script: {p: math.log(n) for p, n in table.items()} for script, table in _PAIRS.items()}


def _likelihood(text: str, script: str) -> float:
    """The sum of the logarithms of the pairs that aren't all ASCII."""
    classes = text.translate(_CLASSES)
    table, unlikely = _LOGS[script], math.log(_UNLIKELY)
    return sum(n * table.get(a + b, unlikely) for (a, b), n in Counter(zip(classes, classes[1:], strict=False)).items() if not (a in "as" and b in "as"))


def detect(content: bytes) -> tuple[str, float]:
    """(encoding, confidence) of the leading bytes: a mark, UTF-8, the likeliest one, or Latin-1."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return name, 1.0
    sample = content[:SAMPLE_BYTES]
    try:
        codecs.getincrementaldecoder("utf-8")().decode(sample, final=len(content) <= SAMPLE_BYTES)
        return "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    if len(sample) < LEAST_BYTES:
        return FALLBACK, 0.0
    found: dict[str, float] = {}
    for name, script in ENCODINGS.items():
        try:
            text = codecs.getincrementaldecoder(name)().decode(sample, final=len(content) <= SAMPLE_BYTES)
        except UnicodeDecodeError:
            continue
        # a text of fewer letters isn't likelier: each byte outside ASCII weighs the same
        found[name] = _likelihood(text, script) * (1 if script != "japanese" else 2)
    best = max(found, key=found.get)
    confidence = 1 / sum(math.exp(max(x - found[best], -700)) for x in found.values())
    return (best, confidence) if confidence >= CONFIDENCE else (FALLBACK, confidence)


def with_encoding(rows: DataFrame) -> DataFrame:
    """Add encoding and confidence to rows with ``content``."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [detect(x) if x is not None else (None, None) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())], [*batch.schema.names, "encoding", "confidence"])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, encoding string, confidence double")
