"""Lifting captures to nodes, edges and symbols, binding imports and names, flow, effects: one composition by path."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.functions import fixed, ids
from sourceloom.functions import text as T
from sourceloom.operators import effects, flow, intervals
from sourceloom.plans.staging import discard, stage_table
from sourceloom.sources import captures

#: Bytes of a file that share a key in joins by containment, so that a large file is many keys.
BIN_BYTES = 1 << 16


_LEADING = r"(?:(?:export|default|public|private|protected|static|override|abstract|declare|readonly)\s+)*"


def signature(header: Column, language: Column, constructor: Column | None = None, params: Column | None = None) -> Column:
    """name(arity)|types|flags of a definition's header; of Python parameters, those that begin with self or cls don't count.

    ``params`` are the parameters as ``captures.definitions`` cuts them by their
    brackets; without them they are read from the header, with brackets four deep.
    """
    python = language == "python"
    header = F.when(python, T.without_decorators(header)).otherwise(header)
    read = captures.split_arguments(F.regexp_extract(header, r"\(((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*\))*+\))*+\))*+)\)", 1), generics=True)
    params = read if params is None else F.coalesce(params, F.array().cast("array<string>"))
    params = F.filter(params, lambda p: ~(python & p.rlike(r"^(self|cls)")))

    def kind(p: Column) -> Column:
        typed = F.when(F.contains(p, F.lit(":")), F.regexp_replace(F.regexp_extract(p, r"(?s):\s*(.*)$", 1), r"<[^<>]*>", "")).otherwise(F.lit(""))
        return F.when(python & p.startswith("**"), F.lit("**")).when(python & p.startswith("*"), F.lit("*")).otherwise(F.coalesce(T.first_identifier(typed), F.lit("?")))

    is_class = header.rlike(rf"^\s*{_LEADING}class\s")
    arrow = ~python & header.rlike(r"=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]*)?=>")
    flags = F.array_compact(F.array(
        F.when(arrow, F.lit("arrow")), F.when(header.rlike(rf"^\s*{_LEADING}async\s+[\w$*]"), F.lit("async")), F.when(is_class, F.lit("class")),
        F.when(F.coalesce(constructor, F.lit(False)) if constructor is not None else F.lit(False), F.lit("ctor")),
        F.when(~python & header.rlike(rf"^\s*{_LEADING}get\s+[\w$]"), F.lit("getter")), F.when(~python & header.rlike(rf"^\s*{_LEADING}set\s+[\w$]"), F.lit("setter")),
    ))
    named = F.regexp_extract(header, r"\b(?:def|class|function\s*\*?|const|let|var)\s+([A-Za-z_$][\w$]*)", 1)
    name = F.when(named != "", named).otherwise(F.regexp_extract(header, rf"^\s*{_LEADING}(?:(?:async|get|set)\s+)*\*?\s*([A-Za-z_$][\w$]*)", 1))
    size = F.when(is_class, 0).otherwise(F.size(params))
    kinds = F.when(is_class, F.lit("")).otherwise(F.array_join(F.transform(F.slice(params, 1, fixed.TYPE_CAP), kind), ","))
    return F.concat(name, F.lit("("), size.cast("string"), F.lit(")|"), kinds, F.lit("|"), F.array_join(flags, ","))


def first_symbols(symbols: DataFrame, *order: str) -> DataFrame:
    """One row for each symbol_id, the first by ``order``."""
    rest = [c for c in symbols.columns if c != "symbol_id"]
    return symbols.groupBy("symbol_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("s")).select("symbol_id", "s.*")


def nearest_definitions(used: DataFrame, entries: DataFrame, keys: list[str], key: str) -> DataFrame:
    """(key, target): of the entries with the name of a use, that of the innermost scope around it, else that of the module.

    ``used`` has keys, name, ``key``, start, end; ``entries`` keys, name, target and
    the scope's start and end, null for the module.
    """
    scopes = entries.select(*[F.col(k).alias(f"s_{k}") for k in (*keys, "name")], F.col("start").alias("s_start"), F.col("end").alias("s_end"), "target")
    on = [used[k].eqNullSafe(scopes[f"s_{k}"]) for k in (*keys, "name")]
    around = F.col("s_start").isNull() | ((F.col("s_start") <= F.col("start")) & (F.col("s_end") >= F.col("end")))
    joined = used.join(scopes, [*on, around])
    return joined.groupBy(key).agg(F.max_by("target", F.struct(F.coalesce("s_start", F.lit(-(1 << 62))), -F.coalesce("s_end", F.lit(0)))).alias("target"))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _span() -> Column:
    return ids.span_key(F.col("path"), F.col("start"), F.col("end"))


def _at() -> Column:
    return F.col("start").cast("string")


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _node(df: DataFrame, semantic: Column | str, raw: Column | str, name: Column, qualified: Column, identity: str = "node_id", preview: Column | None = None) -> DataFrame:
    text = [(F.lit(x) if isinstance(x, str) else x) for x in (semantic, raw)]
    return df.select(
        "path", "language", F.col(identity).alias("node_id"), text[0].alias("semantic_type"), text[1].alias("raw_type"), name.alias("name"), qualified.alias("qualified_name"), "span_key", "start", "end",
        F.concat(F.lit("capture:"), text[1]).alias("reason_label"), (_nothing() if preview is None else preview).alias("preview"),
    )


def _edge(df: DataFrame, kind: str, source: Column | str, target: Column | str, flags: Column | str = "RESOLVED", confidence: Column | float = 1.0, reason: Column | str = "normalize:defines") -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    source, target = (F.col(x) if isinstance(x, str) else x for x in (source, target))
    flags = F.array(F.lit(flags)) if isinstance(flags, str) else flags
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return df.select("path", ids.edge_id(kind, source, target, F.col("span_key")).alias("edge_id"), F.lit(kind).alias("kind"), source.alias("src_id"), target.alias("dst_id"), flags.alias("flags"), confidence.alias("confidence"), "span_key", "start", "end", reason.alias("reason_label"))


def _anomaly(df: DataFrame, kind: str, detail: Column | str, severity: str = "WARN") -> DataFrame:
    return df.select("path", F.lit(kind).alias("anomaly_type"), F.lit(severity).alias("severity"), (F.lit(detail) if isinstance(detail, str) else detail).alias("reason_detail"))


def _capped(placed: DataFrame) -> DataFrame:
    """The captures up to the cap."""
    return placed.filter(F.col("place") <= fixed.CAPTURE_CAP).drop("place")


def _dropped(placed: DataFrame, family: str) -> DataFrame:
    """An anomaly for each file that has more captures than the cap."""
    over = placed.filter(F.col("place") > fixed.CAPTURE_CAP).groupBy("path").agg(F.count("*").alias("dropped"))
    return over.select("path", F.lit("CAPTURE_TRUNCATED").alias("anomaly_type"), F.lit("WARN").alias("severity"), F.concat(F.lit(f"{family}: "), F.col("dropped").cast("string"), F.lit(" captures dropped")).alias("reason_detail"))


#: What is counted of each file, in the order of the metrics.
COUNTED = (
    "defs", "calls", "imports", "exports", "literals", "imports_seen", "imports_resolved", "alias_edges", "local_refs", "blocks", "flow_edges", "facts", "imports_partial",
    "candidate_calls", "matched", "fields_missing",
)


class Graph:
    """The graph of (path, language, text, blob_sha256).

    Nodes, edges, symbols, blocks, facts and effects have their places in bytes and
    what they come from.  What several parts read is a stage table, made when it is
    first asked for, so that a reader of one table doesn't wait for all; ``discard``
    them when the graph has been read.  ``packs`` are the rule packs asked for.
    """

    def __init__(self, files: DataFrame, rules: DataFrame, packs: list[str] | None = None) -> None:
        self.files, self.rules, self.packs = files, rules, packs
        self.stages: list[DataFrame] = []

    def discard(self) -> None:
        """Delete the stage tables; none of the tables can be read after that."""
        discard(*self.stages)

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        self.stages.append(stage_table(df, name))
        return self.stages[-1]

    @cached_property
    def _read(self) -> captures.Read:
        made = captures.read(self.files)
        self.stages += made.stages
        return made

    @property
    def lines(self) -> DataFrame:
        return self._read.lines

    def _placed(self, captured: DataFrame, family: str) -> DataFrame:
        """The captures with their place in the file, as a stage table."""
        sizes = self.lines.groupBy("path").agg(F.max("byte_end").alias("file_end"))
        return self._staged(captures.numbered(captures.sane(captured, sizes), ["path"], "start", "end"), family)

    # definitions and their scopes

    @cached_property
    def _placed_defs(self) -> DataFrame:
        return self._placed(captures.definitions(*self._read.stages, self._staged), "defs")

    @cached_property
    def definitions(self) -> DataFrame:
        defs = _capped(self._placed_defs).withColumn("def_key", F.concat_ws("#", _span(), "name"))
        classes = defs.filter("kind = 'def.class'").select(F.col("def_key").alias("parent"), F.lit(True).alias("in_class"))  # before the join, which isn't made again for them
        around = intervals.nested(defs.select("path", "start", "end", "def_key", "name"), ["path"], "def_key", F.col("name"), bins=BIN_BYTES)
        defs = defs.join(around, "def_key").withColumn("qualified_name", F.concat_ws("::", "path", "chain"))
        method = (F.col("kind") == "def.method") | F.coalesce("in_class", F.lit(False))
        defs = defs.join(classes, "parent", "left").withColumn("semantic_type", F.when(F.col("kind") == "def.class", "Class").when(method, "Method").otherwise("Function"))
        constructor = (F.col("semantic_type") == "Method") & (F.col("name") == "__init__")
        defs = defs.withColumns({"span_key": _span(), "signature": signature(F.col("header"), F.col("language"), constructor, F.col("params"))}).withColumns({
            "node_id": ids.node_id(F.col("semantic_type"), F.col("language"), F.col("qualified_name"), F.col("span_key")),
            "symbol_id": ids.symbol_id(F.col("language"), F.col("qualified_name"), F.lower("semantic_type"), F.col("signature")),
        })
        return self._staged(defs.drop("in_class"), "definitions")

    @cached_property
    def functions(self) -> DataFrame:
        return self._staged(intervals.place_in_order(self.definitions.filter("semantic_type <> 'Class'").select("path", "start", "end", "node_id"), ["path"], "node_id"), "functions")

    @cached_property
    def modules(self) -> DataFrame:
        own_key = ids.span_key(F.col("path"), F.lit(0), F.lit(0))
        modules = self.files.select("path", "language", ids.node_id("Module", F.col("language"), F.col("path"), own_key).alias("node_id"), ids.node_id("File", F.col("language"), F.col("path"), own_key).alias("file_id"), own_key.alias("span_key"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
        return self._staged(modules, "modules")

    # calls, imports, exports, literals

    @cached_property
    def _placed_calls(self) -> DataFrame:
        groups = captures.call_groups(*self._read.stages, self._staged).withColumn("span_key", _span())
        groups = groups.withColumn("qualified_name", F.concat("path", F.lit("::call@"), _at())).withColumn("node_id", ids.node_id("Call", F.col("language"), F.col("qualified_name"), F.col("span_key")))
        groups = groups.withColumns({"used": T.first_identifier(F.col("callee")), "callee_id": ids.symbol_id(F.col("language"), F.coalesce(T.first_identifier(F.col("callee")), F.lit("")), "symbol.ref", F.lit(""))})
        return self._placed(groups, "calls")

    @cached_property
    def calls(self) -> DataFrame:
        return _capped(self._placed_calls)

    @cached_property
    def owned_calls(self) -> DataFrame:
        """The calls with ``owner``, the function around them."""
        owner = intervals.smallest_owner(self.calls.select("path", "start", "end", F.col("node_id").alias("call_id")), self.functions, ["path"], "call_id", "node_id", BIN_BYTES)
        return self._staged(self.calls.join(owner.withColumnRenamed("call_id", "node_id"), "node_id"), "owned-calls")

    @cached_property
    def _placed_imports(self) -> DataFrame:
        rows, found, pairs, _ = self._read.stages
        imported = captures.imports(rows, found, pairs, self._staged).withColumns({"span_key": _span(), "qualified_name": F.concat("path", F.lit("::import@"), _at())})
        return self._placed(imported.withColumn("node_id", ids.node_id("Import", F.col("language"), F.col("qualified_name"), F.col("span_key"))), "imports")

    @cached_property
    def imports(self) -> DataFrame:
        return _capped(self._placed_imports)

    @cached_property
    def exports(self) -> DataFrame:
        exported = captures.exports(self.lines).withColumns({"preview": _nothing(), "span_key": _span(), "qualified_name": F.concat("path", F.lit("::export@"), _at())})
        return self._staged(exported.withColumn("node_id", ids.node_id("Export", F.col("language"), F.col("qualified_name"), F.col("span_key"))), "exports")

    @cached_property
    def _placed_literals(self) -> DataFrame:
        literals = captures.literals(self.lines, self._read.tokens, self._staged)
        literals = literals.withColumn("semantic_type", F.when(F.col("kind") == "lit.template", "TemplatePart").otherwise("Literal"))
        literals = literals.withColumns({"span_key": _span(), "qualified_name": F.concat("path", F.lit("::"), F.lower("semantic_type"), F.lit("@"), _at())})
        return self._placed(literals.withColumn("node_id", ids.node_id(F.col("semantic_type"), F.col("language"), F.col("qualified_name"), F.col("span_key"))).withColumnRenamed("text", "preview"), "literals")

    @cached_property
    def literals(self) -> DataFrame:
        return _capped(self._placed_literals)

    @cached_property
    def bindings(self) -> DataFrame:
        """Names that imports bind."""
        imported = self.imports
        key = [F.col(c) for c in ("path", "language", "node_id", "span_key", "start", "end")]
        python = imported.filter("language = 'python'").select(*key, F.lit(False).alias("type_only"), F.posexplode(T.python_imports(F.col("statement"))).alias("nth", "b"))
        scripts = imported.filter("language <> 'python'").select(*key, F.col("statement").rlike(r"^import\s+type\s").alias("type_only"), F.posexplode(script_imports(F.col("statement"))).alias("nth", "b"))
        bindings = python.unionByName(scripts).select(*key, "type_only", "nth", "b.*")
        source = F.when(F.col("module") != "", F.col("module"))
        canonical = F.concat(F.coalesce(source, F.lit("<external>")), F.lit("::"), F.coalesce("imported", F.lit("*")))
        bindings = bindings.withColumns({
            "alias_id": ids.content_id("sym", "alias", F.col("path"), F.col("alias")), "canonical_id": ids.content_id("sym", "canonical", F.col("path"), canonical),
            "flags": F.array_compact(F.array(F.when(source.isNotNull(), F.lit("RESOLVED")).otherwise(F.lit("PARTIAL")), F.when(F.col("type_only"), F.lit("TYPE_ONLY")))),
            "confidence": F.when(F.col("type_only"), 0.8).when(source.isNotNull(), 1.0).otherwise(0.6),
            "placeholder_id": ids.symbol_id(F.col("language"), F.concat_ws("::", "path", "alias"), "import", F.col("alias")),
        })
        return self._staged(bindings, "bindings")

    @cached_property
    def _unbound(self) -> DataFrame:
        return self.imports.join(self.bindings.select("node_id").distinct(), "node_id", "left_anti")

    # scopes: a module's frame and one for each definition; the first definition of a name in a scope holds

    @cached_property
    def _scoped(self) -> DataFrame:
        defs = self.definitions
        parent_ids = defs.select(F.col("def_key").alias("parent"), F.col("node_id").alias("scope_id"), F.col("start").alias("scope_start"), F.col("end").alias("scope_end"))
        placed = defs.join(parent_ids, "parent", "left").join(self.modules.select("path", F.col("node_id").alias("module_id")), "path")
        return placed.withColumn("parent_id", F.coalesce("scope_id", "module_id"))

    @cached_property
    def frames(self) -> DataFrame:
        return self.modules.select("path", "node_id", _nothing().alias("parent_id"), F.col("path").alias("name"), F.lit("Module").alias("semantic_type"), F.col("path").alias("qualified_name")).unionByName(
            self._scoped.select("path", "node_id", "parent_id", "name", "semantic_type", "qualified_name")
        )

    @cached_property
    def references(self) -> DataFrame:
        first = F.row_number().over(Window.partitionBy("path", "parent_id", "name").orderBy("start", F.col("end").desc(), "node_id"))
        entries = self._scoped.withColumn("first", first).filter("first = 1").select("path", "name", F.col("scope_start").alias("start"), F.col("scope_end").alias("end"), F.col("node_id").alias("target"))
        aliases = self.bindings.groupBy("path", F.col("alias").alias("name")).agg(F.min_by("alias_id", F.struct("start", "nth")).alias("target"))
        aliases = aliases.join(entries.filter("start IS NULL").select("path", "name"), ["path", "name"], "left_anti")
        no_span = F.lit(None).cast("bigint")
        entries = entries.unionByName(aliases.select("path", "name", no_span.alias("start"), no_span.alias("end"), "target"))
        used = self.calls.filter("used IS NOT NULL").select("path", F.col("used").alias("name"), F.col("node_id").alias("call_id"), "start", "end")
        references = nearest_definitions(used, entries, ["path"], "call_id").join(self.calls.select(F.col("node_id").alias("call_id"), "path", "callee_id", "span_key", "start", "end"), "call_id")
        return self._staged(references, "references")

    @cached_property
    def nodes(self) -> DataFrame:
        qualified = F.col("qualified_name")
        return _union(
            _node(self.modules, "File", "file", F.regexp_extract("path", "[^/]*$", 0), F.col("path"), "file_id"), _node(self.modules, "Module", "module", F.col("path"), F.col("path")),
            _node(self.definitions, F.col("semantic_type"), F.col("kind"), F.col("name"), qualified), _node(self.calls, "Call", "call.expr", F.col("callee"), qualified, preview=F.col("preview")),
            _node(self.imports, "Import", F.when(F.col("statement").startswith("from"), "import.from").otherwise("import.stmt"), _nothing(), qualified, preview=F.col("statement")),
            _node(self.exports, "Export", "export.stmt", _nothing(), qualified, preview=F.col("preview")), _node(self.literals, F.col("semantic_type"), F.col("kind"), _nothing(), qualified, preview=F.col("preview")),
        )

    @cached_property
    def edges(self) -> DataFrame:
        modules, defs, groups, bindings = self.modules, self.definitions, self.owned_calls, self.bindings
        owned = _union(*[x.select("path", "node_id", "span_key", "start", "end") for x in (defs, self.imports, self.exports, groups, self.literals)]).join(modules.select("path", F.col("node_id").alias("module_id")), "path")
        names = bindings.select("path", "node_id", "placeholder_id", "alias", "span_key", "start", "end").distinct()
        bound = F.concat(F.lit("bind:import."), "kind")
        return _union(
            _edge(modules, "defines", "file_id", "node_id"), _edge(owned, "defines", "module_id", "node_id"), _edge(defs, "defines", "node_id", "symbol_id"),
            _edge(names, "imports", "node_id", "placeholder_id", "UNRESOLVED", 0.4, "normalize:import.binds"), _edge(bindings, "imports", "node_id", "canonical_id", F.col("flags"), F.col("confidence"), bound),
            _edge(bindings, "aliases", "alias_id", "canonical_id", F.col("flags"), F.col("confidence"), bound),
            _edge(groups.filter("owner IS NOT NULL"), "calls", "owner", "node_id", reason="normalize:callsite"), _edge(groups.filter("used IS NOT NULL"), "calls", "node_id", "callee_id", "UNRESOLVED", 0.5, "normalize:callee"),
            _edge(self.references, "references", "callee_id", "target", "RESOLVED", 0.9, "scope:nearest_def"),
        )

    @cached_property
    def symbols(self) -> DataFrame:
        defs, groups, bindings = self.definitions, self.calls, self.bindings
        symbols = _union(
            defs.select("symbol_id", "name", F.lower("semantic_type").alias("kind"), F.col("qualified_name").alias("scope_qname"), "path", "start", "end"),
            groups.filter("used IS NOT NULL").select(F.col("callee_id").alias("symbol_id"), F.col("used").alias("name"), F.lit("symbol.ref").alias("kind"), F.col("used").alias("scope_qname"), "path", "start", "end"),
            bindings.select(F.col("placeholder_id").alias("symbol_id"), F.col("alias").alias("name"), F.lit("import.symbol").alias("kind"), F.concat_ws("::", "path", "alias").alias("scope_qname"), "path", "start", "end"),
        )
        return first_symbols(symbols, "path", "start")

    # flow: a function's text holds that of the functions in it

    def _within(self, points: DataFrame) -> DataFrame:
        return intervals.containing(points, self.functions, ["path"], bins=BIN_BYTES).withColumnRenamed("o_node_id", "fn_id")

    @cached_property
    def _flow_tokens(self) -> DataFrame:
        words = captures.control_words(self._read.tokens).select("path", F.col("byte").alias("start"), F.col("byte").alias("end"), "pos", "keyword")
        return self._staged(self._within(words).select("fn_id", "pos", "keyword", "path", "start", (F.col("start") + F.length("keyword")).alias("end")), "flow-tokens")

    @cached_property
    def _fns(self) -> DataFrame:
        return self.functions.select(F.col("node_id").alias("fn_id"), "path", "start", "end")

    @cached_property
    def cfg_blocks(self) -> DataFrame:
        return flow.blocks(self._flow_tokens, self._fns)

    @cached_property
    def cfg_edges(self) -> DataFrame:
        return flow.edges(self._flow_tokens, self._fns)

    @cached_property
    def _all_facts(self) -> DataFrame:
        """Facts, those over the cap too."""
        written = self._within(captures.assignments(self.lines).select("path", "name", "expression", "start", F.col("start").alias("end"), F.col("start").alias("pos"), "byte_end"))
        facts = self._staged(flow.written_facts(written.select("fn_id", "name", "expression", "pos", F.col("byte_end").alias("end"))), "written")
        called = self.calls.filter(T.is_effect_call(F.col("preview"), F.col("language"))).select("path", "preview", F.concat(F.lit("call@"), _at()).alias("call"), "start", F.col("start").alias("end"), F.col("start").alias("pos"), F.col("end").alias("call_end"))
        facts = flow.numbered_facts(facts.unionByName(flow.used_facts(facts, self._within(called).select("fn_id", "call", "preview", "pos", F.col("call_end").alias("end")))))
        return self._staged(facts.join(self._fns.select("fn_id", "path"), "fn_id"), "facts")

    @cached_property
    def facts(self) -> DataFrame:
        return self._all_facts.filter(~F.col("cut"))

    @cached_property
    def _matched(self) -> DataFrame:
        """Calls and the rules that match them."""
        calls = self.owned_calls.select(F.col("node_id").alias("call_id"), "path", "language", F.col("start").alias("byte_start"), F.col("end").alias("byte_end"), "preview", "n_args", "args", "kwargs", F.col("owner").alias("owner_fn_id"))
        return self._staged(effects.candidates(calls, self.rules), "matched")

    @cached_property
    def effects(self) -> DataFrame:
        return effects.effects_of(self._matched)

    @cached_property
    def anomalies(self) -> DataFrame:
        bindings, facts = self.bindings, self._all_facts
        captured = _union(*[x.select("path") for x in (self.definitions, self.calls, self.imports, self.exports, self.literals)]).distinct()
        empty = self.files.filter(F.col("text").rlike(r"\S")).select("path").join(captured, "path", "left_anti")
        cuts = [_dropped(rows, family) for rows, family in ((self._placed_defs, "defs"), (self._placed_calls, "calls"), (self._placed_imports, "imports"), (self._placed_literals, "literals"))]
        anomalies = _union(
            _anomaly(bindings.filter("kind = 'star' AND language = 'python'"), "UNCERTAIN_BINDING", "from ... import *"),
            _anomaly(self._unbound, "UNCERTAIN_BINDING", F.concat(F.lit("Unparsed import preview for "), "language")), _anomaly(captures.dynamic_imports(self._read.tokens), "DYNAMIC_IMPORT", "dynamic import()"),
            _anomaly(flow.cut_functions(self._flow_tokens).join(self._fns, "fn_id"), "PARTIAL_PARSE", "CFG_BLOCK_CUTOFF"),
            _anomaly(facts.filter("cut").select("fn_id", "path").distinct(), "CONST_FOLD_CUTOFF", f"facts>{fixed.FACT_CAP}"), _anomaly(empty, "PARTIAL_PARSE", "AST present but no captures; check queries/grammar pin."), *cuts,
        )
        if self.packs is None:
            return anomalies
        asked = self.files.sparkSession.createDataFrame([(x,) for x in self.packs], "pack string")
        missing = effects.missing_packs(asked, self.rules).select(_nothing().alias("path"), F.lit("PARSE_ERROR").alias("anomaly_type"), "severity", F.concat("reason_detail", F.lit(": "), "pack").alias("reason_detail"))
        return anomalies.unionByName(missing)

    @cached_property
    def _pack_errors(self) -> int:
        if self.packs is None:
            return 0
        loaded = {r.pack for r in self.rules.select("pack").distinct().collect()}  # of the configuration
        return len(set(self.packs) - loaded)

    def _rows_of(self, name: str) -> DataFrame:
        """The rows that a metric counts (or sums the ``n`` of)."""
        if name == "calls":
            return self.calls.select("path", F.col("members").alias("n"))
        if name in ("matched", "fields_missing"):
            return self._matched.filter("complete" if name == "matched" else "NOT complete")
        of = {"defs": "definitions", "imports_seen": "imports", "imports_resolved": "bindings", "alias_edges": "bindings", "local_refs": "references", "blocks": "cfg_blocks", "flow_edges": "cfg_edges", "imports_partial": "_unbound", "candidate_calls": "calls"}
        return getattr(self, of.get(name, name))

    def metrics_of(self, *names: str) -> DataFrame:
        """path and these metrics of each file; tables that they don't count aren't made."""
        rows = _counted(self.modules.select("path"), {name: self._rows_of(name) for name in names if name in COUNTED})
        if {"nodes", "errors"} & {*names}:
            rows = rows.join(captures.forest(*self._read.stages[:3]), "path", "left")
        return rows.withColumn("pack_errors", F.lit(self._pack_errors if "pack_errors" in names else 0).cast("bigint")).select("path", *names)

    @cached_property
    def metrics(self) -> DataFrame:
        return self.metrics_of(*COUNTED, "nodes", "errors", "pack_errors")


def build(files: DataFrame, rules: DataFrame, packs: list[str] | None = None) -> Graph:
    """The graph of (path, language, text, blob_sha256)."""
    return Graph(files, rules, packs)


def _counted(paths: DataFrame, counted: dict[str, DataFrame]) -> DataFrame:
    """One row for each path: how many rows (or the sum of their ``n``) each table has of it."""
    parts = [df.select("path", F.lit(name).alias("what"), F.col("n").cast("bigint") if "n" in df.columns else F.lit(1).cast("bigint").alias("n")) for name, df in counted.items()]
    total = _union(*parts).groupBy("path").agg(*[F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for name in counted])
    return paths.join(total, "path", "left").select("path", *[F.coalesce(name, F.lit(0)).alias(name) for name in counted])


def import_aliases(statement: Column, language: Column) -> Column:
    """The names that an import binds, each once, in order; a dotted module binds its first part, a star or a bare script import nothing."""
    bound = F.when(language == "python", T.python_imports(statement)).otherwise(script_imports(statement))
    names = F.transform(F.filter(bound, lambda b: b["kind"] != "star"), lambda b: T.first_identifier(b["alias"]))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull()))


def script_imports(statement: Column) -> Column:
    """array<struct<module, imported, alias, kind>> of one ES import or require line."""
    module = F.regexp_extract(statement, r"(?:from\s*|require\s*\(\s*|^import\s*)['\"]([^'\"]+)['\"]", 1)
    kind = "array<struct<module:string,imported:string,alias:string,kind:string>>"
    body = F.regexp_extract(statement, r"\{([^}]*)\}", 1)
    items = F.filter(F.transform(F.split(body, ","), lambda x: F.regexp_replace(x, r"^\s*(?:type\s+)?|\s+$", "")), lambda x: x != "")

    def binding(item: Column) -> Column:
        pair = F.split(item, r"\s+as\s+|\s*:\s*")
        return F.struct(module.alias("module"), pair[0].alias("imported"), F.element_at(pair, -1).alias("alias"), F.lit("named").alias("kind"))

    def single(found: Column, imported: str, name: str) -> Column:
        return F.when(found != "", F.array(F.struct(module.alias("module"), F.lit(imported).alias("imported"), found.alias("alias"), F.lit(name).alias("kind")))).otherwise(F.array().cast(kind))

    default = F.regexp_extract(statement, r"^import\s+(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:,|from\b)", 1)
    space = F.regexp_extract(statement, r"\*\s*as\s+([A-Za-z_$][\w$]*)", 1)
    required = F.regexp_extract(statement, r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*require", 1)
    only = F.when(statement.rlike(r"^import\s*['\"]"), module).otherwise(F.lit(""))
    return F.concat(single(default, "default", "default"), single(space, "*", "namespace"), F.transform(items, binding), single(required, "*", "module"), single(only, "*", "star"))
