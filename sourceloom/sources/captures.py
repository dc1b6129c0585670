"""Captures of source text: definitions, calls, imports, exports, literals, assignments and control words.

There is no grammar here.  A machine with a stack of modes tells comments and strings
from code (``lexer``): ``code`` is the text with comments blanked and strings filled
up, character by character, so that places in it are places in the text.  Brackets are
paired by windows over their depth, so calls, parameters and import lists may nest and
run over lines to any extent.  All but the machine is native expressions, windows and
joins by path and line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.functions import fixed
from sourceloom.functions.text import latest
from sourceloom.operators.intervals import islands
from sourceloom.plans.staging import stage_table
from sourceloom.session import spread
from sourceloom.sources import lexer

#: Makes a stage table of (rows, name), or leaves the rows as they are.
Keep = Callable[[DataFrame, str], DataFrame]


def _plain(rows: DataFrame, name: str) -> DataFrame:
    return rows


#: A line that begins with one of these goes on with a string.
_WITHIN = f"^[{lexer.CONTINUED}{lexer.HOLE_END}]"
#: The marks of a string, or of its part before, between or after holes.
_MARKS = f"{lexer.HOLE_END}[{lexer.FILLED}{lexer.CONTINUED}]*+{lexer.HOLE}?|[{lexer.FILLED}{lexer.CONTINUED}]++{lexer.HOLE}?"

_NAME = r"[A-Za-z_$][\w$]*+"
_LINK = rf"\s*\??\.\s*{_NAME}"
#: Type arguments three deep, on one line; function types in them have no brackets in their parameters.
_TYPE = r"[\w$ .,\[\]{}:?\u0002\u0003]|\|(?!\|)|&(?!&)|\([^()<>]*+\)\s*+=>"
_TYPES = rf"<(?:{_TYPE}|<(?:{_TYPE}|<(?:{_TYPE})*+>)*+>)*+>"
#: What may stand between a callee and its parenthesis.
_TO_PAREN = rf"\s*(?:\?\.\s*)?(?:{_TYPES}\s*)?"
_CALLED = rf"(?={_TO_PAREN}\()"
#: The name of a call, or the methods called on a value, maybe of the line before: what stands before an opening parenthesis.
_CALLEE = (
    rf"(?<![\w$\u0002\u0003])(?<!(?<!\.\.)\.)(?<!\b(?:def|class|function)\s{{1,8}})(?<!\bfunction\s{{0,8}}\*\s{{0,8}}){_NAME}(?:{_LINK})*+{_CALLED}"
    rf"|(?<=[)\]\u0002\u0003\u0006])(?:{_LINK})++{_CALLED}|^(?:{_LINK})++{_CALLED}"
)
#: Names at the end of a line, on which the next one may call methods.
_CHAIN = rf"(?<![\w$.\u0002\u0003]){_NAME}(?:{_LINK})*+$"
#: A line that calls a method on what stands above.
_HANGS = r"^\s*\??\."
_WORDS = tuple(dict.fromkeys((*fixed.PY_KEYWORDS, *fixed.JS_KEYWORDS)))
_HEADS = ("class", "interface")
_TOKEN = _CALLEE + rf"|(?<![\w$.])(?:{'|'.join((*_WORDS, *_HEADS))})(?![\w$])|[()\[\]{{}},;]|{_MARKS}"
#: What may stand before the name of a member of a class or an interface.
_MODIFIERS = ("public", "private", "protected", "static", "async", "readonly", "abstract", "override", "declare", "get", "set")
_LEAD = rf"(?:(?<![\w$.])(?:{'|'.join(_MODIFIERS)})\s++)*+(?:\*\s*+)?$"
_NOT_CALLS = (
    "and", "as", "assert", "class", "const", "def", "del", "delete", "extends", "from", "function", "global", "import", "in", "instanceof", "interface", "is", "lambda", "let", "new",
    "nonlocal", "not", "of", "or", "raise", "static", "super", "throw", "typeof", "var", "void", "with",
)


def fingerprint() -> str:
    """A hash of the patterns: results that are kept by it are made anew when they change."""
    parts = (lexer.VERSION, _TOKEN, _CHAIN, _LEAD, _PY_DEF, _PY_CLASS, _JS_DEF, _JS_CLASS, *_NOT_CALLS)
    return hashlib.sha256("".join(f"{p}\0" for p in parts).encode()).hexdigest()


@dataclass(frozen=True)
class Read:
    """What all captures of some files are made from, each a stage table."""

    lines: DataFrame
    tokens: DataFrame
    brackets: DataFrame
    members: DataFrame

    @property
    def stages(self) -> list[DataFrame]:
        return [self.lines, self.tokens, self.brackets, self.members]


def read(files: DataFrame) -> Read:
    """Lines, tokens, brackets and members of (path, language, text), written once: the text is gone through once."""
    rows = stage_table(lines(files), "lines")
    found = stage_table(tokens(rows), "tokens")
    pairs = stage_table(brackets(found), "brackets")
    return Read(rows, found, pairs, stage_table(members(found, pairs), "members"))


def lines(files: DataFrame) -> DataFrame:
    """The lines of (path, language, text).

    line_no (from 0), line, code, plain (without comments), char_start,
    byte_start, byte_end, indent (null where no statement can begin), depth (open
    braces before, in Python brackets of all kinds), opened, above (where the code
    before the line ends, and the names that it ends with if the line begins with a dot).
    """
    python = F.col("language") == "python"
    split = {"line": "text", "code": "code", "plain": "plain"}
    rows = lexer.lexed(files).select("path", "language", *[F.split(c, "\n").alias(n) for n, c in split.items()])
    rows = rows.select("path", "language", F.posexplode(F.arrays_zip(*split)).alias("line_no", "z")).select("path", "language", "line_no", "z.*")
    order = Window.partitionBy("path").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def balance(left: str, right: str) -> Column:
        return F.regexp_count("code", F.lit(left)) - F.regexp_count("code", F.lit(right))

    opened = F.when(python, balance(r"[(\[{]", r"[)\]}]")).otherwise(balance(r"\{", r"\}"))
    rows = rows.withColumn("opened", opened).withColumns({
        "char_start": F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)),
        "byte_start": F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)),
        "depth": F.coalesce(F.sum("opened").over(before), F.lit(0)),
    })
    apart = ~python | (F.col("depth") <= 0) | F.col("code").rlike(r"^\s*(?:(?:async\s+)?def|class)\s")  # a bracket may be left open
    begins = (F.trim("code") != "") & ~F.col("code").rlike(_WITHIN) & apart
    code = F.regexp_replace("code", r"[\s\\]+$", "")
    ended = F.when(code != "", F.struct((F.col("char_start") + F.length(code)).alias("at"), (F.col("byte_start") + F.octet_length(F.left("line", F.length(code)))).alias("byte"), "line_no", code.alias("code")))
    above = F.last(ended, ignorenulls=True).over(before)
    chain = F.when(F.col("code").rlike(_HANGS), F.regexp_extract("above.code", _CHAIN, 0))  # few lines ask for it
    return rows.withColumn("above", above).withColumn("above", F.when(F.col("above").isNotNull(), F.struct("above.at", "above.byte", "above.line_no", chain.alias("chain")))).withColumns({
        "byte_end": F.col("byte_start") + F.octet_length("line"),
        "indent": F.when(begins, F.length(F.regexp_extract("code", r"^[ \t]*", 0))),
    })


#: Parts tokens from what stands between them; where a text has this sign, one that means as little stands for it.
_CUT, _OTHER = "\u0007", "\u0001"


def tokens(table: DataFrame, pattern: str = _TOKEN) -> DataFrame:
    """Callees, control words, brackets, commas and strings of the code (or what ``pattern`` tells of them), with their places.

    path, language, line_no, token, start (character), byte, paren (an opening
    parenthesis follows), open (its place), next (the character after the token
    and white space), prior (the visible one before it on its line), base (it follows
    ``extends``), lead (size of the modifiers before it), begins (a member may begin
    there), abstract (one of the modifiers says so).  Methods that are called at the
    beginning of a line stand with the names before them, where the code above ends.
    """
    cut = F.split(F.regexp_replace(F.translate("code", _CUT, _OTHER), pattern, f"{_CUT}$0{_CUT}"), _CUT, -1)  # the text is gone through once
    own = ["path", "language", "line_no", "line", "code", "char_start", "byte_start", "above"]
    pairs = F.transform(F.sequence(F.lit(1), F.size("cut") - 2, F.lit(2)), lambda i: F.struct(F.get("cut", i).alias("token"), F.get("cut", i - 1).alias("before")))
    parts = table.filter(F.col("code").rlike(pattern)) if pattern != _TOKEN else table
    parts = spread(parts, "path", "line_no")  # the lines go to the tasks, and not the many tokens of few files of lines
    # the outer form: of the plain one Spark infers a filter, and cuts each line once more for it
    parts = parts.select(*own, cut.alias("cut")).select(*own, F.posexplode_outer(F.when(F.size("cut") > 1, pairs)).alias("nth", "z")).filter("z IS NOT NULL")
    along = Window.partitionBy("path", "line_no").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("z.token")
    parts = parts.withColumn("offset", (F.sum(F.length("z.before") + size).over(along) - size).cast("int"))
    rest = F.substr("code", F.col("offset") + size + 1)
    blank = F.regexp_extract(rest, r"^\s*", 0)
    to_paren = F.when(F.col("language") == "typescript", F.regexp_extract(rest, rf"^{_TO_PAREN}(?=\()", 0)).when(F.col("language") != "python", F.regexp_extract(rest, r"^\s*(?:\?\.\s*)?(?=\()", 0)).otherwise(blank)
    spaces = F.length(F.when(F.col("z.token").rlike(r"[\w$]$"), F.greatest(to_paren, blank)).otherwise(blank))
    then = F.left(F.substr(rest, spaces + 1), F.lit(1))
    left, script = F.left("code", F.col("offset")), (F.col("language") != "python") & (then == "(")
    hangs = F.col("above").isNotNull() & (F.col("offset") == 0) & F.col("z.token").rlike(_HANGS)
    chain = F.col("above.chain")

    def placed(own: Column, name: str) -> Column:
        """A place in the file, that of the chain for what hangs on the line above."""
        return F.when(hangs, F.col(f"above.{name}") - F.octet_length(chain)).otherwise(own)

    return parts.select(
        "path", "language", F.when(hangs, F.col("above.line_no")).otherwise(F.col("line_no")).alias("line_no"), F.when(hangs, F.concat(chain, F.col("z.token"))).otherwise(F.col("z.token")).alias("token"),
        placed(F.col("char_start") + F.col("offset"), "at").alias("start"), placed(F.col("byte_start") + F.octet_length(F.left("line", F.col("offset"))), "byte").alias("byte"), (then == "(").alias("paren"),
        (F.col("char_start") + F.col("offset") + size + spaces).alias("open"), then.alias("next"),
        F.right(F.rtrim(left), F.lit(1)).alias("prior"), left.rlike(r"\bextends\s+$").alias("base"), F.when(script, F.length(F.regexp_extract(left, _LEAD, 0))).otherwise(0).alias("lead"),
        (script & left.rlike(r"(?:^|[{};,])\s*+" + _LEAD)).alias("begins"), (script & left.rlike(r"\b(?:abstract|declare)\s[\w\s]*+$")).alias("abstract"),
    )


def brackets(found: DataFrame) -> DataFrame:
    """path, kind, open, open_line, close, close_line, closing, next, next_at, commas of each pair of brackets, from their tokens.

    A bracket's depth and its kind of place make the pairs: at one depth, opening
    and closing ones alternate, and the commas between them are those of the pair.
    ``left`` and ``right`` number the brackets of a file in their order: a pair lies
    in another one if its numbers do.
    """
    marks = found.filter(F.col("token").isin(*"()[]{},"))
    opens, closes = F.col("token").isin(*"([{"), F.col("token").isin(*")]}")
    along = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(along)
    nth = F.sum(F.when(opens | closes, 1).otherwise(0)).over(along)
    marks = marks.withColumns({"level": F.when(closes, depth).otherwise(depth - 1), "nth": nth})
    pair = F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy("path", "level").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    pairs = marks.withColumn("pair", pair).groupBy("path", "level", "pair").agg(
        F.min(F.when(opens, F.struct("start", "line_no", "token", "nth"))).alias("a"), F.min(F.when(closes, F.struct("start", "line_no", "next", F.col("open").alias("next_at"), "token", "nth"))).alias("b"),
        F.sort_array(F.collect_list(F.when(F.col("token") == ",", F.col("start")))).alias("commas"),
    )
    return pairs.filter("a IS NOT NULL AND b IS NOT NULL").select(
        "path", F.col("a.token").alias("kind"), F.col("a.start").alias("open"), F.col("a.line_no").alias("open_line"), F.col("b.start").alias("close"), F.col("b.line_no").alias("close_line"),
        F.col("b.token").alias("closing"), F.col("b.next").alias("next"), F.col("b.next_at").alias("next_at"), "commas", F.col("a.nth").alias("left"), F.col("b.nth").alias("right"),
    )


def forest(table: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """path, nodes, errors: the size of a file's forest of statements, brackets and words, and the brackets that have no partner of their kind.

    A file is a node, and so are a line where a statement begins, a pair of
    brackets, and every callee, control word and string.
    """
    bracket = F.col("token").isin(*"()[]{}")
    of_tokens = found.groupBy("path").agg(F.count_if(bracket).alias("brackets"), F.count_if(~bracket & ~F.col("token").isin(",", ";")).alias("words"))
    fits = F.concat("kind", "closing").isin("()", "[]", "{}")
    of_pairs = pairs.groupBy("path").agg(F.count("*").alias("pairs"), F.count_if(fits).alias("fitting"))
    statements = table.groupBy("path").agg(F.count("indent").alias("statements"))
    joined = statements.join(of_tokens, "path", "left").join(of_pairs, "path", "left").na.fill(0, ["brackets", "words", "pairs", "fitting"])
    return joined.select("path", (F.col("statements") + F.col("words") + F.col("pairs") + 1).alias("nodes"), (F.col("brackets") - 2 * F.col("fitting")).alias("errors"))


def slices(spans: DataFrame, table: DataFrame, key: str, column: str = "line") -> DataFrame:
    """Add ``text`` to (path, ``key``, first_line, last_line, from, to): characters ``from`` to ``to`` of the file.

    A null ``to`` is the end of the last line.  ``column`` is what the text is taken from.
    """
    spread = spans.select("path", key, "from", "to", F.explode(F.sequence("first_line", "last_line")).alias("_line"))
    parts = spread.join(table.select("path", F.col("line_no").alias("_line"), "char_start", F.col(column).alias("part")), ["path", "_line"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "part"))), lambda x: x["part"]), "\n")
    texts = parts.groupBy("path", key).agg(F.any_value("from").alias("f"), F.any_value("to").alias("t"), F.min("char_start").alias("c"), whole.alias("w"))
    size = F.coalesce(F.col("t") - F.col("f"), F.length("w")).cast("int")
    return spans.join(texts.select("path", key, F.substr("w", (F.col("f") - F.col("c") + 1).cast("int"), size).alias("text")), ["path", key])


_PY_DEF = r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)"
_PY_CLASS = r"^[ \t]*class[ \t]+(\w+)"
_JS_DEF = r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)|^[ \t]*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>)"
_JS_CLASS = r"\bclass\s+([A-Za-z_$][\w$]*)"


def definitions(table: DataFrame, found: DataFrame | None = None, pairs: DataFrame | None = None, own: DataFrame | None = None, keep: Keep = _plain) -> DataFrame:
    """path, language, kind, name, header, params, start, end (bytes), line_no of every definition.

    A definition of Python ends before the next statement that isn't indented
    more; one of a script with the line at which the braces are back where they
    were, a method of a class with its closing brace; it begins with its first
    modifier.  The header runs to the end of the line that closes the parameters,
    which are null if there are none to close.  ``keep`` takes what is read twice.
    """
    found = tokens(table) if found is None else found
    pairs = brackets(found) if pairs is None else pairs
    python = F.col("language") == "python"
    code = F.col("code")
    def_name = F.when(python, F.regexp_extract(code, _PY_DEF, 1)).otherwise(F.concat(F.regexp_extract(code, _JS_DEF, 1), F.regexp_extract(code, _JS_DEF, 2)))
    class_name = F.when(python, F.regexp_extract(code, _PY_CLASS, 1)).otherwise(F.regexp_extract(code, _JS_CLASS, 1))
    name = F.when(def_name != "", def_name).otherwise(class_name)
    heads = table.withColumns({"name": name, "kind": F.when(def_name != "", "def.func").otherwise("def.class")}).filter((F.col("name") != "") & F.col("indent").isNotNull())
    level = F.when(python, F.col("indent")).otherwise(F.col("depth"))
    heads = heads.withColumn("level", level)

    # the next line that ends a definition of each level: a running value from the end of the file
    levels = heads.groupBy("path").agg(F.collect_set("level").alias("levels"))
    reached = F.when(python, F.col("indent")).otherwise(F.col("depth") + F.col("opened"))
    stop = F.when(python, F.col("byte_start") - 1).otherwise(F.col("byte_end"))
    marks = table.join(levels, "path").select("path", "line_no", F.explode(F.filter("levels", lambda x: x >= reached)).alias("level"), stop.alias("stop"), F.when(python, 1).otherwise(0).alias("tie"), F.lit(None).cast("string").alias("head"))
    begun = heads.select("path", "line_no", "level", F.lit(None).cast("bigint").alias("stop"), F.when(python, 0).otherwise(1).alias("tie"), F.col("name").alias("head"))
    back = Window.partitionBy("path", "level").orderBy(F.col("line_no").desc(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    ends = begun.unionByName(marks).withColumn("stop", F.last("stop", ignorenulls=True).over(back)).filter("head IS NOT NULL").select("path", "line_no", "stop")
    sizes = table.groupBy("path").agg(F.max("byte_end").alias("file_end"))
    heads = heads.join(ends, ["path", "line_no"]).join(sizes, "path")

    # parameters: the parenthesis after the name, or the first one of an assigned function
    at = F.regexp_extract(code, r"^.*?(?:\b(?:def|class|function)\b|=)[^()]*", 0)
    heads = heads.withColumn("open", F.when(F.substr(code, F.length(at) + 1, F.lit(1)) == "(", F.col("char_start") + F.length(at)))
    closes = pairs.filter("kind = '('").select("path", "open", "close", "close_line", "commas")
    spans = heads.join(closes, ["path", "open"], "left").select(
        "path", "language", "kind", "name", "line_no", (F.col("byte_start") + F.when(python, F.col("indent")).otherwise(0)).alias("start"), F.coalesce("stop", "file_end").alias("end"),
        F.col("char_start").alias("from"), F.lit(None).cast("bigint").alias("to"), F.col("line_no").alias("first_line"), F.coalesce("close_line", "line_no").alias("last_line"), "open", "close", "commas",
    )

    # methods and signatures of scripts
    own = members(found, pairs) if own is None else own
    last = table.select("path", F.col("line_no").alias("last_line"), F.col("line").alias("last_text"), F.col("code").alias("last_code"), F.col("char_start").alias("c"), F.col("byte_start").alias("b"))
    size = F.coalesce(F.col("last") - F.col("c") + 1, F.length(F.regexp_replace("last_code", r"[\s,;]+$", ""))).cast("int")
    methods = own.join(last, ["path", "last_line"]).select(
        "path", "language", F.lit("def.method").alias("kind"), "name", "line_no", (F.col("byte") - F.col("lead")).alias("start"), (F.col("b") + F.octet_length(F.left("last_text", size))).alias("end"),
        (F.col("start") - F.col("lead")).alias("from"), F.lit(None).cast("bigint").alias("to"), F.col("line_no").alias("first_line"), F.col("close_line").alias("last_line"), "open", "close", "commas",
    )
    texts = slices(keep(spans.unionByName(methods), "head-spans"), table, "start", "plain")
    params = F.when(F.col("close").isNotNull(), parameters(F.concat(F.array("open"), "commas", F.array("close"))))
    return texts.select("path", "language", "kind", "name", F.trim("text").alias("header"), params.alias("params"), "start", "end", "line_no")


def parameters(bounds: Column) -> Column:
    """The parts of ``text`` (from ``from``) between the places of ``bounds``; in scripts, a comma within ``<>`` parts nothing."""
    cut = F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda x, i: F.regexp_replace(F.substr("text", (x - F.col("from") + 2).cast("int"), (F.get(bounds, i + 1) - x - 1).cast("int")), r"^\s+|\s+$", ""))

    def joined(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        within = F.regexp_count(last, F.lit("<")) > F.regexp_count(last, F.lit("(?<!=)>"))
        return F.when((F.size(done) > 0) & (F.col("language") != "python") & within, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(", "), part)))).otherwise(F.concat(done, F.array(part)))

    return F.filter(F.aggregate(cut, F.array().cast("array<string>"), joined), lambda p: p != "")


def members(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Methods of scripts, and signatures of interfaces and of abstract methods.

    path, language, line_no, name, start, byte, lead, open, close, close_line, commas,
    last (the place of the last character, null for the end of its line), last_line.

    A name with a parenthesis is a method if a brace follows it.  Where a member of
    the body of a class or an interface may begin, a type may stand between: what
    comes next at the same depth, a brace that begins no type, a semicolon or another
    member, tells whether there is a body.
    """
    token, script = F.col("token"), F.col("language") != "python"
    marks = found.filter(script & token.isin(*"()[]{};", *_HEADS))
    opens, closes = token.isin(*"([{"), token.isin(*")]}")
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.select("path", "token", "start", "line_no", "prior", F.when(opens, depth - 1).otherwise(depth).alias("level"))
    along = Window.partitionBy("path", "level").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("path", "level").orderBy(F.col("start").desc()).rowsBetween(Window.unboundedPreceding, -1)
    head = F.last(F.when(token.isin("{", "}", ";", *_HEADS), token), ignorenulls=True).over(along)
    stops = ((token == "{") & ~F.col("prior").isin(*":|&<,=")) | (token == ";") | ((token == "(") & F.col("prior").rlike(r"[\w$>]"))
    then = F.last(F.when(stops, F.struct("token", "start", "line_no")), ignorenulls=True).over(back)
    marks = marks.withColumns({"head": F.when(token == "{", head), "then": then})
    place = "struct<token:string,start:bigint,line_no:int>"
    row = f"struct<key:bigint,start:bigint,box:struct<token:string,head:string>,open:bigint,then:{place}>"
    box = F.struct("level", "start", F.struct("token", "head"), F.lit(None).cast("bigint"), F.lit(None).cast(place)).cast(row)
    asked = F.struct(F.col("level") - 1, "start", F.lit(None).cast("struct<token:string,head:string>"), "start", "then").cast(row)
    boxes = marks.filter(opens).select("path", F.explode(F.when(token == "(", F.array(box, asked)).otherwise(F.array(box))).alias("r")).select("path", "r.*")  # of one pass
    around = F.last("box", ignorenulls=True).over(Window.partitionBy("path", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    placed = boxes.withColumn("around", around).filter("open IS NOT NULL").select("path", "open", F.when(F.col("around.head").isin(*_HEADS), F.col("around.head")).alias("body"), "then")

    names = found.filter(script & F.col("paren") & ~F.col("base") & token.rlike(r"^[A-Za-z_$][\w$]*$") & ~token.isin(*_WORDS, *_NOT_CALLS)).drop("next")
    names = names.join(pairs.filter("kind = '('").select("path", "open", "close", "close_line", "commas", "next", "next_at"), ["path", "open"]).join(placed, ["path", "open"])
    member, next_ = F.col("body").isNotNull() & F.col("begins"), F.col("next")
    typed, bare = member & (next_ == ":"), member & ((F.col("body") == "interface") | F.col("abstract")) & ~next_.isin(":", "{")
    names = names.filter((next_ == "{") | typed | bare).withColumn("brace", F.when(next_ == "{", F.col("next_at")).when(typed & (F.col("then.token") == "{"), F.col("then.start")))
    bodies = pairs.filter("kind = '{'").select("path", F.col("open").alias("brace"), F.col("close").alias("b_close"), F.col("close_line").alias("b_line"))
    ends = F.when(F.col("brace").isNull() & (F.col("then.token") == ";"), F.col("then"))
    return names.join(bodies, ["path", "brace"], "left").filter("brace IS NULL OR b_close IS NOT NULL").select(
        "path", "language", "line_no", token.alias("name"), "start", "byte", "lead", "open", "close", "close_line", "commas",
        F.coalesce("b_close", ends["start"] - 1).alias("last"), F.coalesce("b_line", ends["line_no"], "close_line").alias("last_line"),
    )


def calls(found: DataFrame, pairs: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """path, language, line_no, callee, start, open, close, stop (characters), byte, close_line, commas of every call; not of ``own`` members."""
    python = F.col("language") == "python"
    word = F.when(python, F.col("token").isin(*fixed.PY_KEYWORDS)).otherwise(F.col("token").isin(*fixed.JS_KEYWORDS))
    heads = found.filter(F.col("paren") & F.col("token").rlike(r"[A-Za-z_$]") & ~word & ~F.col("token").isin(*_NOT_CALLS)).drop("next")
    joined = heads.join(pairs.filter("kind = '('").select("path", "open", "close", "close_line", "commas"), ["path", "open"])
    own = members(found, pairs) if own is None else own
    callee = F.regexp_replace(F.regexp_replace("token", r"\s+|\?(?=\.)", ""), r"^\.", "")
    return joined.join(own.select("path", "open"), ["path", "open"], "left_anti").select("path", "language", "line_no", callee.alias("callee"), "start", "open", "close", (F.col("close") + 1).alias("stop"), "byte", "close_line", "commas")


def call_groups(table: DataFrame, found: DataFrame | None = None, pairs: DataFrame | None = None, own: DataFrame | None = None, keep: Keep = _plain) -> DataFrame:
    """Nested and chained calls as one: path, language, callee, preview, args, kwargs, n_args, start, end (bytes), members, line_no.

    Callee and arguments are those of the first call, the preview is the whole text.
    ``keep`` takes what is read twice.
    """
    found = tokens(table) if found is None else found
    pairs = brackets(found) if pairs is None else pairs
    marked = islands(calls(found, pairs, own), ["path"], "start", "stop", "open")
    first = F.min_by(F.struct("callee", "open", "close", "commas"), F.struct("start", -F.col("stop")))
    groups = marked.groupBy("path", "language", "island").agg(
        F.min("start").alias("from"), F.max("stop").alias("to"), F.min("line_no").alias("first_line"), F.max("close_line").alias("last_line"), F.min("byte").alias("start"),
        F.count("*").alias("members"), first.alias("first"),
    )
    texts = slices(keep(groups, "call-spans"), table, "island")
    bounds = F.concat(F.array("first.open"), F.col("first.commas"), F.array("first.close"))
    texts = texts.withColumn("bounds", bounds)

    def argument(x: Column, i: Column) -> Column:
        return F.regexp_replace(F.substr("text", (x - F.col("from") + 2).cast("int"), (F.get("bounds", i + 1) - x - 1).cast("int")), r"^\s+|\s+$", "")

    args = F.filter(F.transform(F.slice("bounds", 1, F.size("bounds") - 1), argument), lambda a: a != "")
    texts = texts.withColumn("args", args)
    named = F.transform(F.filter("args", lambda a: a.rlike(r"^\w+\s*=(?![=>])")), lambda a: F.struct(F.regexp_extract(a, r"^(\w+)", 1).alias("key"), F.regexp_extract(a, r"(?s)^\w+\s*=\s*(.*)$", 1).alias("value")))
    return texts.select(
        "path", "language", F.col("first.callee").alias("callee"), F.col("text").alias("preview"), "args", latest(named).alias("kwargs"), F.size("args").alias("n_args"),
        "start", (F.col("start") + F.octet_length("text")).alias("end"), "members", F.col("first_line").alias("line_no"),
    )


def _nested(depth: int) -> str:
    """A pattern of a bracket with others in it, ``depth`` deep."""
    inner = r"[^()\[\]{}]++"
    out = rf"[(\[{{](?:{inner})*+[)\]}}]"
    for _ in range(depth - 1):
        out = rf"[(\[{{](?:{inner}|{out})*+[)\]}}]"
    return out


def split_arguments(inside: Column, depth: int = 5, generics: bool = False) -> Column:
    """Arguments at commas outside quotes and brackets (``<>`` too, if asked), of a short text that has no places of its own."""
    angle = r"<(?:[^<>]++|<[^<>]*>)*+>|" if generics else ""
    part = rf"((?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|{_nested(depth)}|{angle}[^,'\"`(\[{{{'<' if generics else ''}]++{'|<' if generics else ''})+)"
    return F.filter(F.transform(F.regexp_extract_all(inside, F.lit(part), F.lit(1)), lambda a: F.trim(a)), lambda a: a != "")


def imports(table: DataFrame, found: DataFrame | None = None, pairs: DataFrame | None = None, keep: Keep = _plain) -> DataFrame:
    """path, language, statement (without comments), start, end; a list in brackets may run over any number of lines.

    A list that is never closed is its head line only.  ``keep`` takes what is read twice.
    """
    pairs = brackets(tokens(table) if found is None else found) if pairs is None else pairs
    python = F.col("language") == "python"
    head = F.when(python, F.col("code").rlike(r"^\s*(import\s|from\s+\S+\s+import\b)")).otherwise(F.col("code").rlike(r"^\s*import\b(?!\s*\()|\brequire\s*\("))
    before = F.when(python, F.regexp_extract("code", r"^\s*from\s+\S+\s+import\b[^()]*(?=\()", 0)).otherwise(F.regexp_extract("code", r"^\s*import\s[^({]*(?=\{)", 0))
    heads = table.filter(head).withColumn("open", F.when(before != "", F.col("char_start") + F.length(before)))
    closes = pairs.filter("kind IN ('(', '{')").select("path", "open", "close", "close_line")
    spans = heads.join(closes, ["path", "open"], "left").select(
        "path", "language", "line_no", "byte_start", F.col("char_start").alias("from"), F.when(python, F.col("close") + 1).alias("to"),
        F.col("line_no").alias("first_line"), F.coalesce("close_line", "line_no").alias("last_line"),
    )
    raw = slices(keep(spans, "import-spans"), table, "line_no").withColumnRenamed("text", "raw")
    whole = slices(keep(raw, "import-lines"), table, "line_no", "plain")
    return whole.select("path", "language", F.regexp_replace("text", r"^\s+|\s+$", "").alias("statement"), F.col("byte_start").alias("start"), (F.col("byte_start") + F.octet_length("raw")).alias("end"), "line_no")


def dynamic_imports(found: DataFrame) -> DataFrame:
    """path, byte of the calls of ``import`` in scripts."""
    return found.filter((F.col("language") != "python") & (F.col("token") == "import") & F.col("paren")).select("path", "byte")


def exports(table: DataFrame) -> DataFrame:
    """path, language, start, end of the first line of each export statement of a script."""
    rows = table.filter((F.col("language") != "python") & F.col("code").rlike(r"^\s*export\b"))
    return rows.select("path", "language", (F.col("byte_start") + F.octet_length(F.regexp_extract("line", r"^\s*", 0))).alias("start"), F.col("byte_end").alias("end"), "line_no")


def literals(table: DataFrame, found: DataFrame | None = None, keep: Keep = _plain) -> DataFrame:
    """path, language, kind (lit.string or lit.template), text, start, end of the strings; one may run over lines.  ``keep`` takes what is read twice."""
    found = tokens(table, _MARKS) if found is None else found  # no other token holds a mark
    parts = found.filter(F.col("token").rlike(f"^[{lexer.FILLED}-{lexer.HOLE_END}]"))
    opens, closes = F.col("token").endswith(lexer.HOLE).cast("int"), F.col("token").startswith(lexer.HOLE_END).cast("int")
    along = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum(opens - closes).over(along), F.lit(0)) - closes  # of templates around
    begins = F.when(F.col("token").rlike(_WITHIN), 0).otherwise(1)
    nth = F.sum(begins).over(Window.partitionBy("path", "level").orderBy("start"))
    parts = parts.withColumn("level", level)
    spans = parts.withColumn("nth", nth).groupBy("path", "language", "level", "nth").agg(
        F.min("start").alias("from"), F.max(F.col("start") + F.length("token")).alias("to"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.min("byte").alias("start"),
    )
    texts = slices(keep(spans.withColumn("key", F.concat_ws(":", "level", "nth")), "literal-spans"), table, "key")
    kind = F.when(F.col("text").startswith("`"), "lit.template").otherwise("lit.string")
    return texts.select("path", "language", kind.alias("kind"), "text", "start", (F.col("start") + F.octet_length("text")).alias("end"), F.col("first_line").alias("line_no"))


def assignments(table: DataFrame) -> DataFrame:
    """path, language, name, expression (without comments), start, byte_end of ``x = ...`` lines; in scripts with const, let or var."""
    python = F.col("language") == "python"

    def part(group: int) -> Column:
        tail = r"\s*=(?![=>])\s*(.+?)\s*;?\s*$"
        return F.when(python, F.regexp_extract("plain", r"^\s*([A-Za-z_]\w*)" + tail, group)).otherwise(F.regexp_extract("plain", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)" + tail, group))

    before = F.regexp_extract("plain", r"^\s*(?:(?:export\s+)?(?:const|let|var)\s+)?", 0)
    rows = table.filter("indent IS NOT NULL AND code LIKE '%=%'").select("path", "language", "line_no", part(1).alias("name"), part(2).alias("expression"), (F.col("byte_start") + F.octet_length(before)).alias("start"), "byte_end")
    return rows.filter("name <> ''")


def control_words(found: DataFrame) -> DataFrame:
    """path, line_no, keyword, pos (character), byte of control words outside strings and comments."""
    own = F.when(F.col("language") == "python", F.col("token").isin(*fixed.PY_KEYWORDS)).otherwise(F.col("token").isin(*fixed.JS_KEYWORDS))
    return found.filter(own).select("path", "line_no", F.col("token").alias("keyword"), F.col("start").alias("pos"), "byte")


def kind_of(kind: Column) -> Column:
    """struct<semantic, raw> of a capture kind; null for unknown ones."""
    known = F.create_map(*[x for k, (semantic, raw) in fixed.CAPTURE_KINDS.items() for x in (F.lit(k), F.struct(F.lit(semantic).alias("semantic"), F.lit(raw).alias("raw")))])
    return F.try_element_at(known, kind)


def sane(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The rows whose span is one, and ends within its file if ``sizes`` (path, file_end) are given."""
    kept = rows.filter((F.col("start") >= 0) & (F.col("end") >= F.col("start")))
    return kept if sizes is None else kept.join(sizes, "path").filter(F.col("end") <= F.col("file_end")).drop("file_end")


def numbered(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """Add ``place``, from 1 in each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def capped(rows: DataFrame, keys: list[str], *order: str | Column, cap: int = fixed.CAPTURE_CAP) -> tuple[DataFrame, DataFrame]:
    """The first rows of each key with their ``place``; and the keys that have more, with the number of rows ``dropped``."""
    kept = numbered(rows, keys, *order).filter(F.col("place") <= cap)
    over = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > cap)
    return kept, over.select(*keys, (F.col("n") - cap).alias("dropped"))
