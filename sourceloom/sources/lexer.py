"""Comments and strings told from code by a machine with a stack of modes.

Scripts nest: a template holds code in ``${}``, that code may hold templates again;
elements of JSX hold text, tags and code.  So the machine has a mode (code, a kind of
string, a comment, a tag, an element's text) and a stack of what it will go back to.

A long text is cut at line ends into pieces.  What a piece does is a map from the
state at its start to that at its end.  It doesn't need the whole stack: it is read
once from every mode, and only where something is closed that was opened before the
piece, it goes on once for each thing that this may have been.  Such maps compose, so
a file's pieces are read in different tasks, their small maps are folded in the order
of the file, and every piece is then rendered from its own state.  A text of one piece
is rendered at once.

``code`` has comments and the text of elements blanked, and strings filled up with
marks; ``plain`` has comments blanked only.  Both keep every character's place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.session import bound_batches, ship_package

#: Characters of a piece, about; it ends with a line.
PIECE_CHARS = 1 << 16
#: Changes with what the machine does: part of the fingerprint of results that are kept.
VERSION = "2"

#: Marks in ``code``: a string's characters, the first one of a line that continues a
#: string, the ends of code within a template, and the characters of a regular expression.
FILLED, CONTINUED, HOLE, HOLE_END, REGEX = "\u0002", "\u0003", "\u0004", "\u0005", "\u0006"

# Modes: code where a value may begin, code after a value, and the others by their sign.
_BEGIN, _AFTER, _LINE, _BLOCK, _TAG, _TEXT, _CLOSING = "c", "d", "l", "b", "t", "x", "e"
_TRIPLES = {"D": '"""', "S": "'''"}
_ATTRIBUTES = {"q": '"', "p": "'"}
# What may lie on the stack: a brace, a template's hole, an element's hole, a tag's hole; an element in code, one in another.
_OPENED = {"{": _BEGIN, "T": "`", "J": _TEXT, "A": _TAG}
_ELEMENTS = {"R": _AFTER, "E": _TEXT}

_PY_STOP = re.compile(r"[\"'#]")
_JS_STOP = re.compile(r"[\"'`/{}]")
_JSX_STOP = re.compile(r"[\"'`/{}<]")
_SHORT = {q: re.compile(rf"[^{q}\\\n]*(?:\\[\s\S][^{q}\\\n]*)*\\?") for q in "\"'"}
_LONG = {q: re.compile(rf"[^{q}\\]*(?:(?:\\[\s\S]|{q}(?!{q}{q}))[^{q}\\]*)*\\?") for q in "\"'"}
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*\\?")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_ELEMENT = re.compile(r"<(?![\w$]+\s+extends\b)(?:[A-Za-z_$][\w$.:-]*[\s/>{]|>)")
_TAG_STOP, _TEXT_STOP = re.compile(r"[\"'{>]|/>"), re.compile(r"[<{]")
_LAST_WORD = re.compile(r"[\w$]+\Z")
#: Words after which a value begins.
_BEFORE_VALUES = frozenset("await case delete do else extends in instanceof new of return throw typeof void yield".split())
_VISIBLE = re.compile(r"[^\n]")

# Classes of a segment.
_CODE, _COMMENT, _STRING, _MORE, _HOLE, _HOLE_END, _VALUE, _ELEMENT_TEXT = range(8)


class Machine:
    """One language's machine over one text."""

    def __init__(self, text: str, python: bool, jsx: bool) -> None:
        self.text, self.python, self.jsx = text, python, jsx
        self.stop = _PY_STOP if python else _JSX_STOP if jsx else _JS_STOP

    def entries(self) -> str:
        """Modes in which a line may begin."""
        return "c\"'" + ("DS" if self.python else "d`b" + ("txqpe" if self.jsx else ""))

    def after(self, part: str, mode: str) -> str:
        """The mode after a part of code."""
        end = part.rstrip()
        if not end:
            return mode
        word = _LAST_WORD.search(end)
        if word:
            return _BEGIN if word[0] in _BEFORE_VALUES and not end[: word.start()].endswith(".") else _AFTER
        return _AFTER if end[-1] in ")]" or end.endswith(("++", "--")) else _BEGIN

    def run(self, at: int, mode: str, stack: list[str], out: list[tuple[int, int, int]] | None = None) -> tuple[int, str]:
        """Read on; (-1, mode) at the end, or (place, kinds of things) where something is closed that isn't on the stack.

        ``out`` gets the segments; with it, the stack is the whole one, and what
        closes nothing is code.
        """
        text, n = self.text, len(self.text)

        def put(kind: int, a: int, b: int) -> None:
            if out is not None and b > a:
                out.append((kind, a, b))

        begun = False  # of a string: its first segment is put
        while at < n:
            if mode in (_BEGIN, _AFTER):
                found = self.stop.search(text, at)
                end = found.start() if found else n
                if end > at:
                    put(_CODE, at, end)
                    if not self.python:
                        mode = self.after(text[at:end], mode)
                    at = end
                if not found:
                    break
                sign = text[at]
                begun = True
                if sign in "\"'":
                    mode = sign
                    if self.python and text.startswith(sign * 3, at):
                        mode = "D" if sign == '"' else "S"
                elif sign == "`":
                    mode = "`"
                elif sign == "#":
                    mode = _LINE
                elif sign == "/":
                    then = text[at + 1 : at + 2]
                    regex = _REGEX.match(text, at) if mode == _BEGIN and then not in ("/", "*") else None
                    if then == "/":
                        mode = _LINE
                    elif then == "*":
                        mode = _BLOCK
                    elif regex:
                        put(_VALUE, at, regex.end())
                        at, mode = regex.end(), _AFTER
                    else:
                        put(_CODE, at, at + 1)
                        at, mode = at + 1, _BEGIN
                elif sign == "{":
                    put(_CODE, at, at + 1)
                    stack.append("{")
                    at, mode = at + 1, _BEGIN
                elif sign == "}":
                    if not stack and out is None:
                        return at, "}"
                    top = stack.pop() if stack and stack[-1] in _OPENED else "{"
                    put(_HOLE_END if top == "T" else _CODE, at, at + 1)
                    at, mode, begun = at + 1, _OPENED[top], False
                else:  # <
                    if mode == _BEGIN and _ELEMENT.match(text, at):
                        stack.append("R")
                        mode = _TAG
                    else:
                        mode = _BEGIN
                    put(_CODE, at, at + 1)
                    at += 1
            elif mode in ("'", '"', "D", "S", "`"):
                quote = _TRIPLES.get(mode, mode)
                pattern = _TEMPLATE if mode == "`" else _LONG[quote[0]] if mode in _TRIPLES else _SHORT[mode]
                start = at
                end = pattern.match(text, at + len(quote) if begun else at).end()
                if text.startswith(quote, end):
                    at, then = end + len(quote), _AFTER if not self.python else _BEGIN
                elif end < n and mode == "`":  # a hole
                    put(_STRING if begun else _MORE, start, end + 1)
                    put(_HOLE, end + 1, end + 2)
                    stack.append("T")
                    at, mode = end + 2, _BEGIN
                    continue
                else:  # the line's end closes a short string; the text's end leaves it open
                    at, then = end, mode if end >= n else _AFTER if not self.python else _BEGIN
                put(_STRING if begun else _MORE, start, at)
                mode, begun = then, False
            elif mode in (_LINE, _BLOCK):
                end = text.find("\n", at) if mode == _LINE else text.find("*/", at + 2 if begun else at)
                closed = end >= 0
                end = n if not closed else end if mode == _LINE else end + 2
                put(_COMMENT, at, end)
                # a comment changes nothing, but whether a value has ended before isn't kept: few divisions follow comments
                at, mode, begun = end, _BEGIN if closed or mode == _LINE else _BLOCK, False
            elif mode in _ATTRIBUTES:
                end = text.find(_ATTRIBUTES[mode], at + 1 if begun else at)
                put(_STRING if begun else _MORE, at, n if end < 0 else end + 1)
                at, mode, begun = (n, mode, False) if end < 0 else (end + 1, _TAG, False)
            elif mode == _TAG:
                found = _TAG_STOP.search(text, at)
                end = found.start() if found else n
                put(_CODE, at, end)
                at = end
                if not found:
                    break
                if found[0] in "\"'":
                    mode, begun = "q" if found[0] == '"' else "p", True
                elif found[0] == "{":
                    put(_CODE, at, at + 1)
                    stack.append("A")
                    at, mode = at + 1, _BEGIN
                elif found[0] == ">":
                    put(_CODE, at, at + 1)
                    at, mode = at + 1, _TEXT
                else:
                    if not stack and out is None:
                        return at + 1, ">"
                    put(_CODE, at, at + 2)
                    at, mode = at + 2, _ELEMENTS[stack.pop()] if stack and stack[-1] in _ELEMENTS else _AFTER
            elif mode == _TEXT:
                found = _TEXT_STOP.search(text, at)
                end = found.start() if found else n
                put(_ELEMENT_TEXT, at, end)
                at = end
                if not found:
                    break
                put(_CODE, at, at + 1)
                if found[0] == "{":
                    stack.append("J")
                    mode = _BEGIN
                elif text.startswith("/", at + 1):
                    mode = _CLOSING
                else:
                    stack.append("E")
                    mode = _TAG
                at += 1
            else:  # the tag that closes an element
                end = text.find(">", at)
                if end >= 0 and not stack and out is None:
                    return end, ">"
                put(_CODE, at, n if end < 0 else end + 1)
                if end < 0:
                    break
                at, mode = end + 1, _ELEMENTS[stack.pop()] if stack and stack[-1] in _ELEMENTS else _AFTER
        return -1, mode

    def map(self) -> dict[tuple[int, str], tuple[int, str, str]]:
        """What the text does: (place, mode) to (place, kind of thing closed, '') or, at its end, (-1, mode, stack)."""
        known: dict[tuple[int, str], tuple[int, str, str]] = {}
        todo = [(0, mode) for mode in self.entries()]
        while todo:
            key = todo.pop()
            if key in known:
                continue
            stack: list[str] = []
            at, what = self.run(*key, stack)
            known[key] = (at, what, "".join(stack))
            if at >= 0:
                then = _OPENED if what == "}" else _ELEMENTS
                todo += [(at + 1, mode) for sign, mode in then.items() if sign in ("{T" if not self.jsx else "{TJARE")]
        return known

    def render(self, mode: str = _BEGIN, stack: str = "") -> tuple[str, str]:
        """``code`` and ``plain``, from the state at the start."""
        out: list[tuple[int, int, int]] = []
        self.run(0, mode, list(stack), out)
        code, plain = [], []
        for kind, a, b in out:
            part = self.text[a:b]
            plain.append(_VISIBLE.sub(" ", part) if kind == _COMMENT else part)
            if kind in (_COMMENT, _ELEMENT_TEXT):
                part = _VISIBLE.sub(" ", part)
            elif kind in (_STRING, _MORE):
                part = _VISIBLE.sub(FILLED, part).replace("\n" + FILLED, "\n" + CONTINUED)
                if kind == _MORE and a == 0 and part[0] == FILLED:
                    part = CONTINUED + part[1:]
            elif kind in (_HOLE, _HOLE_END):
                part = HOLE if kind == _HOLE else HOLE_END
            elif kind == _VALUE:
                part = _VISIBLE.sub(REGEX, part)
            code.append(part)
        return "".join(code), "".join(plain)


def moved(known: dict[tuple[int, str], tuple[int, str, str]], mode: str, stack: str) -> tuple[str, str]:
    """The state after a piece, from its map and the state before."""
    at, what, pushed = known[0, mode]
    while at >= 0:
        then = _OPENED if what == "}" else _ELEMENTS
        top, usual = stack[-1:], "{" if what == "}" else "R"
        stack, top = (stack[:-1], top) if top and top in then else (stack, usual)
        at, what, pushed = known[at + 1, then[top]]
    return what, stack + pushed


def cut(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text in pieces of about ``size`` characters, each but the last ending with a line."""
    out, a = [], 0
    while len(text) - a > size:
        end = text.rfind("\n", a, a + size) + 1 or text.find("\n", a + size) + 1
        if not end:
            break
        out.append(text[a:end])
        a = end
    return [*out, text[a:]]


def _machine(path: str | None, language: str | None, text: str) -> Machine:
    return Machine(text, language == "python", not (path or "").lower().endswith(".ts"))


def _each(batches: Iterator[pa.RecordBatch], columns: list[str], schema: pa.Schema, one) -> Iterator[pa.RecordBatch]:
    """The rows that ``one`` makes of each row's columns; batches are bounded by their bytes."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
        made = [row for x in rows for row in one(*x)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * len(schema), schema.types, strict=True)], schema=schema)


_STATE = "array<struct<at:int,mode:string,then:int,what:string,stack:string>>"
_LEXED = pa.schema([(c, pa.string()) for c in ("path", "language", "text", "code", "plain")])
_PIECES = pa.schema([("path", pa.string()), ("language", pa.string()), ("piece", pa.int32()), ("text", pa.string())])
_STRUCT = pa.list_(pa.struct([("at", pa.int32()), ("mode", pa.string()), ("then", pa.int32()), ("what", pa.string()), ("stack", pa.string())]))
_MAPS = pa.schema([*_PIECES, ("known", _STRUCT)])
_STATES = pa.schema([("path", pa.string()), ("piece", pa.int32()), ("mode", pa.string()), ("stack", pa.string())])
_RENDERED = pa.schema([("path", pa.string()), ("language", pa.string()), ("piece", pa.int32()), ("text", pa.string()), ("code", pa.string()), ("plain", pa.string())])


def _render_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _each(batches, ["path", "language", "text"], _LEXED, lambda p, lang, t: [(p, lang, t, *_machine(p, lang, t).render())])


def _map_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(path, language, piece, text):
        known = [(at, mode, *then) for (at, mode), then in _machine(path, language, text).map().items()]
        return [(path, language, piece, text, [dict(zip(("at", "mode", "then", "what", "stack"), x, strict=True)) for x in known])]

    return _each(batches, ["path", "language", "piece", "text"], _MAPS, one)


def _fold(table: pa.Table) -> pa.Table:
    """The state before each piece of one file."""
    mode, stack, rows = _BEGIN, "", []
    for path, piece, known in sorted(zip(*(table.column(c).to_pylist() for c in ("path", "piece", "known")), strict=True), key=lambda r: r[1]):
        rows.append((path, piece, mode, stack))
        mode, stack = moved({(k["at"], k["mode"]): (k["then"], k["what"], k["stack"]) for k in known}, mode, stack)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STATES.types, strict=True)], schema=_STATES)


def _render_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(path, language, piece, text, mode, stack):
        return [(path, language, piece, text, *_machine(path, language, text).render(mode, stack))]

    return _each(batches, ["path", "language", "piece", "text", "mode", "stack"], _RENDERED, one)


def lexed(files: DataFrame, size: int = PIECE_CHARS) -> DataFrame:
    """(path, language, text) with ``code`` and ``plain``; long texts are read in pieces by several tasks."""
    ship_package(files.sparkSession)
    bound_batches(files.sparkSession)
    rows = files.select(*[F.col(c).cast("string").alias(c) for c in ("path", "language", "text")]).filter("text IS NOT NULL")
    schema = "path string, language string, text string, code string, plain string"
    whole = rows.filter(F.length("text") <= size).mapInArrow(_render_files, schema)

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each(batches, ["path", "language", "text"], _PIECES, lambda p, lang, t: [(p, lang, i, x) for i, x in enumerate(cut(t, size))])

    pieces = rows.filter(F.length("text") > size).mapInArrow(pieces_of, "path string, language string, piece int, text string").repartition("path", "piece")
    maps = pieces.mapInArrow(_map_pieces, f"path string, language string, piece int, text string, known {_STATE}")
    states = maps.select("path", "piece", "known").groupBy("path").applyInArrow(_fold, "path string, piece int, mode string, stack string")
    placed = pieces.join(states, ["path", "piece"]).select("path", "language", "piece", "text", "mode", "stack")
    rendered = placed.mapInArrow(_render_pieces, "path string, language string, piece int, text string, code string, plain string")
    parts = F.array_sort(F.collect_list(F.struct("piece", "text", "code", "plain")))
    long = rendered.groupBy("path", "language").agg(parts.alias("p")).select("path", "language", *[F.array_join(f"p.{c}", "").alias(c) for c in ("text", "code", "plain")])
    return whole.unionByName(long)
