"""Content-addressed ids: 24 hex digits of SHA-256 over NUL-terminated parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUL = "\0"


def _text(part: Column | str) -> Column:
    column = F.lit(part) if isinstance(part, str) else part
    return F.coalesce(column.cast("string"), F.lit(""))


def content_id(*parts: Column | str) -> Column:
    """Strings are constants; each part ends in NUL."""
    pieces = [p for part in parts for p in (_text(part), F.lit(_NUL))]
    return F.substring(F.sha2(F.concat(*pieces), 256), 1, 24)


def span_key(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def node_id(semantic: Column | str, language: Column, qualified: Column, span: Column) -> Column:
    return content_id("node", semantic, language, qualified, span)


def edge_id(kind: Column | str, source: Column, target: Column, span: Column) -> Column:
    return content_id("edge", kind, source, target, span)


def symbol_id(language: Column, qualified: Column, kind: Column | str, signature: Column) -> Column:
    return content_id("sym", language, qualified, kind, signature)


def receipt_id(path: Column, start: Column, end: Column, label: Column | str) -> Column:
    """Parts are separated, not ended, by NUL."""
    return F.substring(F.sha2(F.concat_ws(_NUL, _text(path), _text(start), _text(end), _text(label)), 256), 1, 24)
