"""Effects: calls matched with rule packs, fields extracted and normalised.

``rules`` has one row per pattern: pack, rule_id, language, kind, provider,
family, confidence, callee, object_method, arg_min, arg_max, fields, file_regex.
A few of them are tried on every call of their language.  From ``INDEX_FROM`` on they
are found by an inverted index: a pattern needs some literal text, so each part of it
must stand in a call; the calls' texts, each once, are listed under their parts of the
same sizes, patterns under the one of theirs that the fewest texts have, and only where
these are equal is the pattern tried.  Parts have up to ``LONGEST`` letters: there are
about as many of them as there are names, so lists stay short however many calls and
patterns there are.  Patterns that need no such text are tried by language.
Rules are broadcast only up to ``MAX_RULE_ROWS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import fixed
from sourceloom.functions import text as T
from sourceloom.functions.ids import content_id, receipt_id
from sourceloom.plans.staging import stage_table

MAX_RULE_ROWS = 10_000
#: Patterns from which the index is cheaper than trying each of them.
INDEX_FROM = 256
#: Letters of a part of the index, at least and at most.
GRAM, LONGEST = 3, 8
RULE_SCHEMA = (
    "pack string, tag string, rule_id string, language string, pattern_language string, kind string, provider string, family string, confidence double, pattern_kind string, "
    "callee string, object_method string, arg_min int, arg_max int, fields array<struct<name:string,source:string,index:int,key:string,value_expr:string>>, file_regex string"
)


def callee_matches(preview: Column, callee: Column) -> Column:
    spec = F.replace(callee, F.lit(" "), F.lit(""))
    return F.when(callee.startswith("re:"), F.regexp_like(preview, F.substr(callee, F.lit(4)))).otherwise(F.contains(preview, spec))


def method_matches(preview: Column, method: Column) -> Column:
    return F.when(method.startswith("re:"), F.regexp_like(preview, F.substr(method, F.lit(4)))).otherwise(F.contains(preview, F.concat(method, F.lit("("))))


def text_matches() -> Column:
    """A call's text (preview) against a pattern: callee and method must hold if they are set."""
    by_callee = F.col("callee").isNull() | callee_matches(F.col("preview"), F.col("callee"))
    by_method = F.col("object_method").isNull() | method_matches(F.col("preview"), F.col("object_method"))
    some = F.col("callee").isNotNull() | F.col("object_method").isNotNull()
    return some & by_callee & by_method & F.col("pattern_kind").isin("call", "decorator")


def call_matches() -> Column:
    """What else of a call (path, n_args) a pattern asks for."""
    args = F.col("n_args").between(F.coalesce("arg_min", F.lit(0)), F.coalesce("arg_max", F.lit(2147483647)))
    return args & (F.col("file_regex").isNull() | F.regexp_like("path", "file_regex"))


def pattern_matches() -> Column:
    """A call (preview, path, n_args) against a pattern: every part that is set must hold."""
    return text_matches() & call_matches()


def by_language(rules: DataFrame) -> DataFrame:
    """Each pattern once for every ``call_language`` that it and its rule fit."""
    languages = F.array(*[F.lit(x) for x in dict.fromkeys(fixed.LANGUAGES.values())])
    fits = F.filter(languages, lambda x: F.col("language").isin("any") | (F.col("language") == x))
    fits = F.filter(fits, lambda x: F.col("pattern_language").isin("any") | (F.col("pattern_language") == x))
    return rules.withColumn("call_language", F.explode(fits))


_SPECIAL = ".^$*+?()[]{}|/-"


def required_literals(pattern: Column) -> Column:
    """The texts that every match of a regular expression holds; one empty text if none can be told.

    Told are expressions without alternatives, flags and escapes of codes: classes,
    groups, and what may be repeated or missing, cut the literal.
    """
    hidden = {c: chr(0xE000 + i) for i, c in enumerate(_SPECIAL)}
    out = F.replace(pattern, F.lit("\\\\"), F.lit("\ue0ff"))
    for c, mark in hidden.items():  # signs that stand for themselves
        out = F.replace(out, F.lit("\\" + c), F.lit(mark))
    gap = "\u0001"
    out = F.regexp_replace(out, r"\\[A-Za-z]", gap)
    out = F.regexp_replace(out, r"\[\^?\]?[^\]]*\]", gap)
    for _ in range(3):
        out = F.regexp_replace(out, r"\([^()]*\)", gap)
    out = F.regexp_replace(out, r".(?:[*?]|\{[^}]*\})[+?]?", gap)
    out = F.regexp_replace(out, r"(.)\+[+?]?", "$1" + gap)
    out = F.regexp_replace(out, r"[.^$]", gap)
    told = ~pattern.rlike(r"\||\(\?|\\[0-9xuQEcpPkN]") & ~out.rlike(r"[()\[\]{}*+?]")
    shown = F.translate(out, "".join([*hidden.values(), "\ue0ff"]), _SPECIAL + "\\")
    return F.when(told, F.split(shown, gap)).otherwise(F.array(F.lit("")))


def required_literal(pattern: Column) -> Column:
    """The longest of the ``required_literals``."""
    return F.array_max(F.transform(required_literals(pattern), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]


def literals_of() -> Column:
    """The texts of ``GRAM`` letters or more that a call must hold to match a pattern (callee, object_method)."""

    def of(spec: Column, plain: Column) -> Column:
        return F.coalesce(F.when(spec.startswith("re:"), required_literals(F.substr(spec, F.lit(4)))).otherwise(F.array(plain)), F.array(F.lit("")))

    both = F.concat(of(F.col("callee"), F.replace("callee", F.lit(" "), F.lit(""))), of(F.col("object_method"), F.concat("object_method", F.lit("("))))
    return F.filter(both, lambda x: F.length(x) >= GRAM)


def grams(text: Column, sizes: Sequence[int] = (GRAM,)) -> Column:
    """The distinct parts of ``sizes`` letters."""

    def of(size: int) -> Column:
        last = F.length(text) - size + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(size) for size in sizes]))


def parts(literal: Column) -> Column:
    """The parts of a text that a pattern needs: of ``LONGEST`` letters, or the whole of a shorter one."""
    return F.coalesce(F.when(F.length(literal) >= LONGEST, grams(literal, (LONGEST,))), F.array(literal))


def _indexed(listed: DataFrame, left: DataFrame, small: bool) -> DataFrame:
    """Calls with the patterns of ``listed`` (which need a text of ``GRAM`` letters) that share their rarest part; equal texts are looked at once."""

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df  # at most MAX_RULE_ROWS patterns

    numbered = stage_table(listed.withColumn("_pattern", F.monotonically_increasing_id()), "rules")
    asked = numbered.select("_pattern", F.explode(F.flatten(F.transform("_literals", parts))).alias("_gram"))
    sizes = sorted(r[0] for r in asked.select(F.length("_gram")).distinct().collect())  # from GRAM to LONGEST
    if not sizes:
        return left.join(numbered.limit(0), F.col("own_language") == F.col("call_language")).drop("_pattern")
    texts = left.select("preview").distinct().withColumn("_gram", F.explode(grams(F.col("preview"), sizes)))
    texts = stage_table(texts.join(sent(asked.select("_gram").distinct()), "_gram"), "call-parts")
    seen = texts.groupBy("_gram").agg(F.count("*").alias("n"))
    counted = asked.join(seen, "_gram", "left").groupBy("_pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_gram")).alias("r"))
    chosen = counted.filter("r.n > 0").select("_pattern", F.col("r._gram").alias("_rarest"))  # a part that no call has: no match
    keyed = numbered.join(chosen, "_pattern")
    fitting = texts.join(sent(keyed), F.col("_gram") == F.col("_rarest")).filter(text_matches()).withColumnRenamed("preview", "_preview")
    return left.join(fitting, (F.col("preview") == F.col("_preview")) & (F.col("own_language") == F.col("call_language")) & call_matches()).drop("_preview", "_gram", "_rarest", "_pattern")


def matched(calls: DataFrame, rules: DataFrame, index: bool | None = None) -> DataFrame:
    """One row per call and rule, however many of its patterns match; ``index`` tells whether to use the index, else their number does."""
    number = rules.limit(MAX_RULE_ROWS + 1).count()
    small = number <= MAX_RULE_ROWS
    listed = by_language(rules)
    left = calls if "path" in calls.columns else calls.withColumn("path", F.lit(None).cast("string"))
    left = left.withColumnRenamed("language", "own_language")
    found, few = None, small
    if number >= INDEX_FROM if index is None else index:
        listed = listed.withColumn("_literals", literals_of())
        found = _indexed(listed.filter(F.size("_literals") > 0), left, small).drop("_literals")
        listed = stage_table(listed.filter(F.size("_literals") == 0).drop("_literals"), "tried-rules")
        few = listed.limit(MAX_RULE_ROWS + 1).count() <= MAX_RULE_ROWS  # else all calls of a language would meet in a task
    tried = left.join(F.broadcast(listed) if few else listed, (F.col("own_language") == F.col("call_language")) & pattern_matches())
    found = tried if found is None else found.unionByName(tried)
    return found.drop("own_language").dropDuplicates(["call_id", "rule_id"])


def expanded(template: Column, args: Column, kwargs: Column) -> Column:
    """A text with ``${i}`` and ``${kw:name}`` replaced by arguments; a missing one is empty."""
    hole = r"\$\{(?:\d+|kw:\w+)\}"

    def value(found: Column) -> Column:
        key = F.regexp_extract(found, r"kw:(\w+)", 1)
        return F.coalesce(F.when(key != "", F.try_element_at(kwargs, key)).otherwise(F.get(args, F.regexp_extract(found, r"\d+", 0).try_cast("int"))), F.lit(""))

    def whole(found: Column) -> Column:
        return F.array_join(F.transform(F.split(template, hole, -1), lambda x, i: F.concat(x, F.when(i < F.size(found), value(F.get(found, i))).otherwise(F.lit("")))), "")

    return T.let(F.regexp_extract_all(template, F.lit(hole), F.lit(0)), whole)


def field_value(args: Column, kwargs: Column, path: Column, spec: Column) -> Column:
    """The raw value of a field; null if missing."""
    value = F.when(spec["source"] == "arg", F.get(args, F.coalesce(spec["index"], F.lit(0)))).when(spec["source"] == "kw", F.try_element_at(kwargs, spec["key"]))
    value = value.when(spec["source"] == "literal", expanded(spec["value_expr"], args, kwargs)).when(spec["source"] == "filename", path)
    return F.when(value != "", value)


def normalised(kind: Column, name: Column, value: Column) -> Column:
    """array<struct<key, value>> of the normalised forms of one field."""
    field = F.lower(name)
    plain = T.strip_quotes(value)

    def one(key: Column | str, v: Column) -> Column:
        return F.array(F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), v.cast("string").alias("value")))

    none = F.array().cast("array<struct<key:string,value:string>>")
    http = F.when(field.isin("path", "route"), one("path", T.http_path(value))).when(field.isin("method", "verb"), one("method", T.http_method(plain)))
    http = http.when(field.isin("status", "status_code"), one("status", T.http_status(value))).when(field.isin("host", "base_url"), one("host", plain))
    db = F.when(field.isin("sql", "query"), F.concat(one("op", T.sql_operation(plain)), one("table", T.sql_table(plain)))).when(field.isin("table", "model"), one("table", plain)).when(field.isin("op", "operation"), one("op", F.upper(plain)))
    out = F.when(kind == "http.route", F.coalesce(http, none)).when(kind.isin("db.sql", "db.orm"), F.coalesce(db, none))
    out = out.when(kind == "messaging", F.coalesce(F.when(field.isin("topic", "queue"), one("topic", T.topic(value))), none))
    rpc = F.when(field.isin("operation", "op", "operation_name"), one("operation", value)).when(field.isin("type", "op_type"), one("op_type", F.lower(value)))
    out = out.when(kind.isin("graphql", "rpc"), F.coalesce(rpc, none))
    for kinds, names in ((("io.file", "io.blob"), ("path", "key", "bucket")), (("auth",), ("provider", "scope", "audience")), (("scheduler",), ("cron", "interval"))):
        out = out.when(kind.isin(*kinds), F.coalesce(F.when(field.isin(*names), one(name, plain)), none))
    out = out.when(kind == "feature_flag", F.coalesce(F.when(field.isin("flag", "key"), one("flag_key", plain)), none))
    return F.filter(out.otherwise(one(name, plain)), lambda x: x["value"].isNotNull() & (x["value"] != ""))


def candidates(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls and the rules that match them, with the fields ``found``; ``complete`` if there is one, or the rule has none."""
    raw = F.transform("fields", lambda f: F.struct(f["name"].alias("key"), T.redact_effect(field_value(F.col("args"), F.col("kwargs"), F.col("path"), f)).alias("value")))
    rows = matched(calls, rules).withColumn("found", F.filter(raw, lambda f: f["value"].isNotNull()))
    return rows.withColumn("complete", (F.size("fields") == 0) | (F.size("found") > 0))


def detect(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Effects of (call_id, path, language, byte_start, byte_end, preview, n_args, args, kwargs, owner_fn_id)."""
    return effects_of(candidates(calls, rules))


def effects_of(rows: DataFrame) -> DataFrame:
    """Effects of ``candidates``.

    A rule whose fields are all missing gives no effect; one without fields does.
    Of fields with one name, and of fields with one normalised key, the last one
    holds.  An HTTP method that isn't a verb is taken from the callee.
    """
    rows = rows.filter("complete")
    pairs = F.flatten(F.transform("found", lambda f: normalised(F.col("kind"), f["key"], f["value"])))
    rows = rows.withColumns({"literals": T.latest(F.col("found")), "normalized_values": T.latest(pairs)})
    verb = F.try_element_at("normalized_values", F.lit("method"))
    fixed_verb = F.when(~verb.isin(*fixed.HTTP_VERBS), T.default_method(F.regexp_extract("preview", r"^[^(]*", 0)))
    others = F.map_filter("normalized_values", lambda k, v: k != "method")
    rows = rows.withColumn("normalized_values", F.when(fixed_verb.isNotNull(), F.map_concat(others, F.create_map(F.lit("method"), fixed_verb))).otherwise(F.col("normalized_values")))
    receipt = receipt_id(F.col("path"), F.col("byte_start"), F.col("byte_end"), "group")
    return rows.select(
        content_id(receipt, F.col("rule_id")).alias("effect_id"), "kind", "provider", "family", "owner_fn_id", "literals", "normalized_values", receipt.alias("receipt_id"),
        "path", F.col("call_language").alias("language"), "call_id", "rule_id", F.coalesce("tag", "pack").alias("tag"), "confidence", "byte_start", "byte_end",
    )


def missing_packs(wanted: DataFrame, rules: DataFrame) -> DataFrame:
    """Packs that are asked for but not loaded."""
    return wanted.join(rules.select("pack").distinct(), "pack", "left_anti").select("pack", F.lit("WARN").alias("severity"), F.lit("Rule pack not loaded").alias("reason_detail"))
