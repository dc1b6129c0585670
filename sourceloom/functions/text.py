"""Text functions of the code graph, as native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions import fixed

IDENTIFIER = r"[A-Za-z_$][\w$]*"


def _mask(token: Column) -> Column:
    return F.when(F.length(token) <= 8, F.lit("***")).otherwise(F.concat(F.lit("***"), F.right(token, F.lit(4))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def latest(pairs: Column) -> Column:
    """A map of array<struct<key, value>>; of equal keys the last one holds."""

    def last_ones(p: Column) -> Column:
        return F.map_from_entries(F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["key"] == x["key"])))

    return let(F.filter(pairs, lambda x: x["key"].isNotNull()), last_ones)


def mask_pattern(text: Column, pattern: str) -> Column:
    """Replace every match by *** and, if it is longer than 8, its last four characters."""

    def masked(t: Column) -> Column:
        def join(tokens: Column) -> Column:
            return F.array_join(F.transform(F.split(t, pattern, -1), lambda x, i: F.concat(x, F.coalesce(_mask(F.get(tokens, i)), F.lit("")))), "")

        return F.when(t.rlike(pattern), let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), join)).otherwise(t)

    return let(text, masked)


def redact_store(text: Column) -> Column:
    """For persistence: mask, then cap at 200 characters with an ellipsis."""
    for pattern in fixed.STORE_PATTERNS:
        text = mask_pattern(text, pattern)
    cap = fixed.PREVIEW_CHARS
    return F.coalesce(let(text, lambda t: F.when(F.length(t) > cap, F.concat(F.left(t, F.lit(cap)), F.lit("…"))).otherwise(t)), F.lit(""))


def redact_effect(text: Column) -> Column:
    """For effects: cap first, higher thresholds, no ellipsis."""
    text = F.left(text, F.lit(fixed.PREVIEW_CHARS))
    for pattern in fixed.EFFECT_PATTERNS:
        text = mask_pattern(text, pattern)
    return text


def redact_capture(text: Column, file_size: Column) -> Column:
    """For captures: cap by file size with an ellipsis, then mask long tokens."""
    cap = F.when(file_size > fixed.LARGE_FILE, F.lit(fixed.PREVIEW_LARGE_CHARS)).otherwise(F.lit(fixed.PREVIEW_CHARS))
    text = F.when(F.length(text) > cap, F.concat(F.left(text, cap), F.lit("…"))).otherwise(text)
    for pattern in fixed.CAPTURE_PATTERNS:
        text = mask_pattern(text, pattern)
    return text


def strip_quotes(text: Column, marks: str = "\"'") -> Column:
    return F.regexp_replace(F.trim(text), f"^[{marks}]+|[{marks}]+$", "")


def http_path(path: Column) -> Column:
    """One form for parameters, single slashes, no trailing slash."""
    t = strip_quotes(path)
    for pattern, by in (
        (r"\[(\.\.\.)?([A-Za-z0-9_]+)\??\]", ":$2"),
        (r"\$\{([A-Za-z0-9_]+)\}", ":$1"),
        (r"\{([A-Za-z0-9_]+)\}", ":$1"),
        (r":([A-Za-z0-9_]+)<[^>]+>", ":$1"),
        (r"//+", "/"),
        (r"(.)/$", "$1"),
    ):
        t = F.regexp_replace(t, pattern, by)
    return F.when(path == "", path).when(t == "", F.lit("/")).otherwise(t)


def http_method(method: Column) -> Column:
    return F.upper(F.trim(F.coalesce(method, F.lit(""))))


def http_status(text: Column) -> Column:
    found = F.regexp_extract(text, r"\d{3}", 0)
    return F.when(found != "", found.cast("int"))


def default_method(callee: Column) -> Column:
    """The HTTP verb that a callee names, upper-cased; null if none."""
    verbs = "|".join(v.lower() for v in fixed.HTTP_VERBS)
    found = F.regexp_extract(F.lower(callee), rf"\b({verbs})\b", 1)
    return F.when(found != "", F.upper(found))


def sql_operation(sql: Column) -> Column:
    return F.upper(F.regexp_extract(strip_quotes(sql, '`"'), rf"(?i)^\s*({'|'.join(fixed.SQL_OPS)})\b", 1))


def sql_table(sql: Column) -> Column:
    """The first table by a rough pattern; null if none."""
    s, op = strip_quotes(sql, '`"'), sql_operation(sql)
    read = F.regexp_extract(s, r'(?i)\bFROM\s+([A-Za-z0-9_."]+)', 1)
    write = F.regexp_extract(s, r'(?i)\b(?:INTO|UPDATE|FROM)\s+([A-Za-z0-9_."]+)', 1)
    table = strip_quotes(F.when(op == "SELECT", read).when(op.isin("INSERT", "UPDATE", "DELETE"), write).otherwise(F.lit("")), '"')
    return F.when(table != "", table)


def topic(name: Column) -> Column:
    return F.regexp_replace(strip_quotes(F.coalesce(name, F.lit(""))), "//+", "/")


def first_identifier(text: Column) -> Column:
    found = F.regexp_extract(text, IDENTIFIER, 0)
    return F.when(found != "", found)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language_of(path: Column) -> Column:
    """By lower-cased extension; null if not supported."""
    out = F.lit(None).cast("string")
    for suffix, language in fixed.LANGUAGES.items():
        out = F.when(extension(path) == suffix, F.lit(language)).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """A shell pattern whose * crosses slashes, as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out += ".*"
            continue
        if c == "?":
            out += "."
        elif end > 0:
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?:{out})$"


def matches_any(path: Column, globs: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for glob in globs:
        out = out | path.rlike(glob_regex(glob))
    return out


def without_decorators(header: Column) -> Column:
    """A Python header without the decorators and blank lines before it."""
    return F.regexp_replace(header, r"^(?:\s*+@[\w.]++(?:\((?:[^()]++|\([^()]*+\))*+\))?+[^\n]*+\n)++\s*+", "")


def module_name(path: Column, root: str | None = None) -> Column:
    return F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "") if root else path


def is_pathlike(name: Column) -> Column:
    return F.lower(name).rlike("|".join(fixed.PATH_TOKENS))


def is_effect_call(preview: Column, language: Column) -> Column:
    low = F.lower(preview)

    def any_of(tokens: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(low, t))

    return F.when(language == "python", any_of(fixed.PY_EFFECT_TOKENS)).otherwise(any_of(fixed.JS_EFFECT_TOKENS))


def pathological(text: Column) -> Column:
    """Names of the signs that a text is hard to parse, comma-joined."""
    lines = F.slice(F.split(text, "\n"), 1, fixed.LONG_LINES)
    dense = (F.length(text) >= fixed.DENSE_CHARS) & (F.regexp_count(text, F.lit(r"\s")) / F.length(text) < fixed.DENSE_SHARE)
    minified = F.exists(lines, lambda x: F.length(x) >= fixed.LONG_LINE) | dense
    array_head = F.left(text, F.lit(fixed.ARRAY_CHARS))
    massive = F.contains(array_head, F.lit("[")) & (F.regexp_count(array_head, F.lit(",")) > fixed.ARRAY_COMMAS)
    opening = F.regexp_count(F.left(text, F.lit(fixed.NESTING_CHARS)), F.lit(r"[\[({]"))
    nested = F.when(opening >= fixed.NESTING_DEPTH, max_nesting(text) >= fixed.NESTING_DEPTH)  # fewer brackets can't be so deep
    return F.concat_ws(",", F.when(minified, "minified"), F.when(nested, "nesting"), F.when(massive, "array"))


def max_nesting(text: Column) -> Column:
    """Deepest bracket depth in the leading characters; the depth never falls below 0."""
    marks = F.regexp_extract_all(F.left(text, F.lit(fixed.NESTING_CHARS)), F.lit(r"[\[\](){}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc: Column, mark: Column) -> Column:
        depth = F.greatest(acc["d"] + F.when(mark.isin("(", "[", "{"), 1).otherwise(-1), F.lit(0))
        return F.struct(depth.alias("d"), F.greatest(acc["m"], depth).alias("m"))

    return F.aggregate(marks, start, step, lambda acc: acc["m"])


def python_imports(statement: Column) -> Column:
    """array<struct<module, imported, alias, kind>> of one ``import`` or ``from`` statement."""
    flat = F.regexp_replace(F.regexp_replace(statement, r"[()\\\n]", " "), r"\s+", " ")
    source = F.regexp_extract(flat, r"^\s*from\s+([.\w]+)\s+import\s", 1)
    items = F.filter(F.transform(F.split(F.regexp_replace(flat, r"^\s*(?:from\s+[.\w]+\s+)?import\s+", ""), ","), lambda x: F.trim(x)), lambda x: x != "")

    def binding(item: Column) -> Column:
        name, alias = F.regexp_extract(item, r"^([.\w*]+)", 1), F.regexp_extract(item, r"\sas\s+(\w+)$", 1)
        kind = F.when(source == "", "module").when(name == "*", "star").otherwise("named")
        return F.struct(
            F.when(source == "", name).otherwise(source).alias("module"),
            F.when(source != "", name).alias("imported"),
            F.when(alias != "", alias).otherwise(name).alias("alias"), kind.alias("kind"),
        )

    empty = F.array().cast("array<struct<module:string,imported:string,alias:string,kind:string>>")
    return F.when(flat.rlike(r"^\s*(from\s+[.\w]+\s+import\s|import\s)"), F.transform(items, binding)).otherwise(empty)


_LITERAL = r"(?s)^(['\"`])((?:(?!\1)[^\\]|\\.)*)\1$"


def fold_concat(expression: Column) -> Column:
    """struct<value, flags>: a literal, or literals joined by + with {x} for what isn't one; a + in quotes is text."""

    def folded(parts: Column) -> Column:
        literal = F.exists(parts, lambda p: p.rlike(_LITERAL))
        whole = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(_LITERAL), F.regexp_extract(p, _LITERAL, 2)).otherwise(F.lit("{x}"))), "")
        deep = F.size(parts) > fixed.FOLD_DEPTH
        flags = (
            F.when(deep, F.array(F.lit("DYNAMIC"), F.lit("FOLD_DEPTH")))
            .when(F.forall(parts, lambda p: p.rlike(_LITERAL)), F.array(F.lit("FOLDED")))
            .when(literal, F.array(F.lit("FOLDED"), F.lit("NON_LITERAL_PART")))
            .otherwise(F.array(F.lit("DYNAMIC")))
        )
        return F.struct(F.when(deep, F.lit("dyn:{x}")).when(literal, whole).otherwise(F.lit("dyn:{x}")).alias("value"), flags.alias("flags"))

    part = r"(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|[^+'\"`])+"
    parts = F.filter(F.transform(F.regexp_extract_all(expression, F.lit(part), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")
    return let(parts, folded)


def string_literals(code: Column) -> Column:
    """The contents of quoted strings, in order."""
    pattern = r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\""
    return F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(0)), lambda s: F.substring(s, F.lit(2), F.length(s) - 2))


def normalize_call(expression: Column) -> Column:
    """One path of the arguments of os.path.join, path.join and URL, {x} for what isn't literal; null for other calls."""
    inside = F.regexp_extract(expression, r"^\s*(?:os\.path\.join|path\.join|(?:new\s+)?URL)\s*\((.*)\)\s*$", 1)
    is_url = expression.rlike(r"^\s*(?:new\s+)?URL\s*\(")
    comma_part = r"(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|\((?:[^()]|\([^()]*\))*\)|[^,'\"`(])+"
    items = F.transform(F.regexp_extract_all(inside, F.lit(comma_part), F.lit(0)), lambda a: F.trim(a))
    parts = F.transform(items, lambda a: F.when(a.rlike(_LITERAL), strip_quotes(a)).otherwise(F.lit("{x}")))
    joined = F.array_join(F.when(is_url, F.reverse(parts)).otherwise(parts), "/")
    return F.when(F.trim(inside) != "", F.regexp_replace(joined, r"(?<!:)//+", "/"))
