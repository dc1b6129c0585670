"""Registered queries of the code graph, over source files that Spark writes out of the ``part`` table.

Each part is a source file of one of four shapes with the part's own names and
values in it, so that the graph's work grows with the table.  The SQL makes the
expected rows from the shapes and the same parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions import text as T
from sourceloom.operators import discovery, graph
from sourceloom.plans.staging import stage_table
from sourceloom.queries import query, table
from sourceloom.session import compile_in_tasks, measured_session, partitions, spread
from sourceloom.sources import captures, encodings
from sourceloom.sources.rule_packs import Registry

#: Source texts by p_partkey % 4; @k is p_partkey, @z p_size, @b p_brand.
SHAPES = (
    '''import m@z as s, os
from pkg.x@z import a as b, c

class C@k:
    def f(self, a, b: int):
        if a:
            return g@z(a)
        return b

@router.get("/parts/{id}/@z/")
def u@k(x):
    base_url = "@b"
    session.execute("SELECT * FROM t@z")
    return x
''',
    '''import os
def a@k(x, y=g(1)):
    """doc: if x: return h(2)
while é text
    """
    p = f@z(1) + f@z(2) // g(x)
    return h@z(
        p, [1, (2, 3)],
        "(if",
    )
# if call(3)
class K@k(Base):
    async def m(self, *xs, **kw):
        for i in xs:
            a@k(2)
            yield i.j(1).l(2)
''',
    '''import D, { a as b@z } from "m@z"; // c(1)
/* if (x) { call(1) } */
export class K@k extends mix(B) {
  foo(a, b = (c) => d(c)) {
    return `t ${x(1)} if`;
  }
}
function f@k(x, y) {
  if (x) { return g@z(x); }
}
app.post("/p@k//{id}/", h)
''',
    '''from m@z import *
from a import (
    n@k as q,  # a (
    r,
)
def u@k():
    path = os.path.join("@b", 'c+d', name)
    url = "h" + x
    t = build()
    table_t = load()
    open(path)
    fetch@z(url)
    return path
''',
)


def parts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the parts that files are made of, before they are."""
    own = measured_session(spark, partitions(table(spark, sf_dir, "part")))
    return spread(table(own, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = parts_of(spark, sf_dir)
    shape = F.element_at(F.array(*[F.lit(x) for x in SHAPES]), (F.col("p_partkey") % 4 + 1).cast("int"))
    for mark, column in (("@k", "p_partkey"), ("@z", "p_size"), ("@b", "p_brand")):
        shape = F.replace(shape, F.lit(mark), F.col(column).cast("string"))
    script = F.col("p_partkey") % 4 == 2
    path = F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.when(script, ".js").otherwise(".py"))
    return parts.select(path.alias("path"), F.when(script, "javascript").otherwise("python").alias("language"), shape.alias("text"), F.lit("").alias("blob_sha256"))


def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, in a session for the many plans of a graph."""
    files = source_files(spark, sf_dir)
    compile_in_tasks(files.sparkSession)
    return files


_built: dict[tuple[str, str], graph.Graph] = {}


def built(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """The graph of the files, once in an application: its stage tables are made for the query that first needs them, and serve all."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        registry = Registry()
        registry.load_folder()
        files = graph_files(spark, sf_dir)
        _built[key] = graph.build(files, registry.table(files.sparkSession), ["fastapi@0.115", "none"])
    return _built[key]


_P = "p AS (SELECT *, 'src/p' || p_partkey || CASE WHEN p_partkey % 4 = 2 THEN '.js' ELSE '.py' END AS path, p_partkey::VARCHAR AS k, p_size::VARCHAR AS z, p_brand AS b FROM part)"


def _by_shape(columns: str, rows: list[tuple]) -> str:
    """SQL of rows (shape, one expression for each column)."""
    names = columns.split()
    parts = [f"SELECT path, {', '.join(f'{v} AS {n}' for n, v in zip(names, row[1:], strict=True))} FROM p WHERE p_partkey % 4 = {row[0]}" for row in rows]
    return f"WITH {_P} " + " UNION ALL ".join(parts)


def _q(text: str) -> str:
    """A text with @k, @z and @b as an SQL expression."""
    out = "'" + text.replace("'", "''") + "'"
    for mark, column in (("@k", "k"), ("@z", "z"), ("@b", "b")):
        out = out.replace(mark, f"' || {column} || '")
    return out


def _many(shape: int, kind: str, *names: str | None) -> list[tuple]:
    return [(shape, _q(kind), "NULL" if n is None else _q(n), f"{names.count(n)}::BIGINT") for n in dict.fromkeys(names)]


_NODES = [
    *_many(0, "Class", "C@k"), *_many(0, "Method", "f"), *_many(0, "Function", "u@k"), *_many(0, "Import", None, None), *_many(0, "Call", "g@z", "router.get", "session.execute"), *_many(0, "Literal", None, None, None),
    *_many(1, "Function", "a@k"), *_many(1, "Class", "K@k"), *_many(1, "Method", "m"), *_many(1, "Import", None), *_many(1, "Call", "g", "f@z", "f@z", "g", "h@z", "a@k", "i.j"), *_many(1, "Literal", None, None),
    *_many(2, "Class", "K@k"), *_many(2, "Method", "foo"), *_many(2, "Function", "f@k"), *_many(2, "Import", None), *_many(2, "Export", None), *_many(2, "Call", "mix", "d", "x", "g@z", "app.post"), *_many(2, "Literal", None, None), *_many(2, "TemplatePart", None),
    *_many(3, "Function", "u@k"), *_many(3, "Import", None, None), *_many(3, "Call", "os.path.join", "build", "load", "open", "fetch@z"), *_many(3, "Literal", None, None, None),
]
_NODES += [(shape, kind, name, "1::BIGINT") for shape in range(4) for kind, name in (("'Module'", "path"), ("'File'", "substr(path, 5)"))]


@query(_by_shape("semantic_type name n", _NODES))
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).nodes.groupBy("path", "semantic_type", "name").agg(F.count("*").alias("n"))


_SCOPES = [(0, "C@k", ""), (0, "C@k::f", "C@k"), (0, "u@k", ""), (1, "a@k", ""), (1, "K@k", ""), (1, "K@k::m", "K@k"), (2, "K@k", ""), (2, "K@k::foo", "K@k"), (2, "f@k", ""), (3, "u@k", "")]


@query(_by_shape("qualified_name parent", [(s, f"path || {_q('::' + q)}", f"path || {_q('::' + p)}" if p else "path") for s, q, p in _SCOPES] + [(s, "path", "NULL") for s in range(4)]))
def graph_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes and the scopes around them."""
    frames = built(spark, sf_dir).frames
    outer = frames.select(F.col("node_id").alias("parent_id"), F.col("qualified_name").alias("parent"))
    return frames.join(outer, "parent_id", "left").select("path", "qualified_name", "parent")


_CALLS = [
    (0, "g@z", "g@z(a)", "a"), (0, "router.get", 'router.get("/parts/{id}/@z/")', '"/parts/{id}/@z/"'), (0, "session.execute", 'session.execute("SELECT * FROM t@z")', '"SELECT * FROM t@z"'),
    (1, "g", "g(1)", "1"), (1, "f@z", "f@z(1)", "1"), (1, "f@z", "f@z(2)", "2"), (1, "g", "g(x)", "x"), (1, "h@z", 'h@z(\n        p, [1, (2, 3)],\n        "(if",\n    )', 'p|[1, (2, 3)]|"(if"'),
    (1, "a@k", "a@k(2)", "2"), (1, "i.j", "i.j(1).l(2)", "1"),
    (2, "mix", "mix(B)", "B"), (2, "d", "d(c)", "c"), (2, "x", "x(1)", "1"), (2, "g@z", "g@z(x)", "x"), (2, "app.post", 'app.post("/p@k//{id}/", h)', '"/p@k//{id}/"|h'),
    (3, "os.path.join", "os.path.join(\"@b\", 'c+d', name)", "\"@b\"|'c+d'|name"), (3, "build", "build()", ""), (3, "load", "load()", ""), (3, "open", "open(path)", "path"), (3, "fetch@z", "fetch@z(url)", "url"),
]


@query(_by_shape("callee preview args", [(row[0], *[_q(x) for x in row[1:]]) for row in _CALLS]))
def capture_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their texts, cut out of the files by their byte spans, and their arguments."""
    files = source_files(spark, sf_dir)
    groups = captures.call_groups(*captures.read(files).stages)
    text = F.decode(F.substr(F.encode("text", "UTF-8"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    return groups.join(files.select("path", "text"), "path").select("path", "callee", text.alias("preview"), F.array_join("args", "|").alias("args"))


_TEXTS = [(0, '"/parts/{id}/@z/"'), (0, '"@b"'), (0, '"SELECT * FROM t@z"'), (1, '"""doc: if x: return h(2)\nwhile é text\n    """'), (1, '"(if"'), (2, '"m@z"'), (2, "`t ${x(1)} if`"), (2, '"/p@k//{id}/"'), (3, '"@b"'), (3, "'c+d'"), (3, '"h"')]


@query(_by_shape("kind text size", [(s, "'lit.template'" if t[0] == "`" else "'lit.string'", _q(t), f"octet_length(encode({_q(t)}))::BIGINT") for s, t in _TEXTS]))
def capture_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.literals(stage_table(captures.lines(source_files(spark, sf_dir)), "lines")).select("path", "kind", "text", (F.col("end") - F.col("start")).alias("size"))


_BINDINGS = [(0, "m@z", None, "s", "module"), (0, "os", None, "os", "module"), (0, "pkg.x@z", "a", "b", "named"), (0, "pkg.x@z", "c", "c", "named"), (1, "os", None, "os", "module"), (2, "m@z", "default", "D", "default"), (2, "m@z", "a", "b@z", "named"), (3, "m@z", "*", "*", "star"), (3, "a", "n@k", "q", "named"), (3, "a", "r", "r", "named")]


@query(_by_shape("module imported alias kind", [(row[0], *["NULL" if x is None else _q(x) for x in row[1:]]) for row in _BINDINGS]))
def graph_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).bindings.select("path", "module", "imported", "alias", "kind")


#: By shape: defined nodes and symbols, bindings, calls with an owner, calls, references.
_EDGES = {0: (15, 4, 2, 3, 0), 1: (17, 1, 7, 7, 1), 2: (17, 2, 3, 5, 0), 3: (13, 3, 5, 5, 0)}
_EDGE_ROWS = [
    (shape, _q(kind), _q(flag), f"{n}::BIGINT")
    for shape, (defined, bound, owned, called, referred) in _EDGES.items()
    for kind, flag, n in (("defines", "RESOLVED", defined), ("imports", "UNRESOLVED", bound), ("imports", "RESOLVED", bound), ("aliases", "RESOLVED", bound), ("calls", "RESOLVED", owned), ("calls", "UNRESOLVED", called), ("references", "RESOLVED", referred))
    if n
]


@query(_by_shape("kind flags n", _EDGE_ROWS))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to modules to what they hold to symbols; imports to names and sources; owners to calls to callees to definitions."""
    return built(spark, sf_dir).edges.groupBy("path", "kind", F.array_join("flags", ",").alias("flags")).agg(F.count("*").alias("n"))


@query(_by_shape("name target", [(1, _q("a@k"), f"path || {_q('::a@k')}")]))
def graph_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called names and the definitions that they mean."""
    g = built(spark, sf_dir)
    found = g.edges.filter("kind = 'references'").select("path", F.col("src_id").alias("symbol_id"), F.col("dst_id").alias("node_id"))
    return found.join(g.symbols.select("symbol_id", "name"), "symbol_id").join(g.nodes.select("node_id", F.col("qualified_name").alias("target")), "node_id").select("path", "name", "target")


@query(
    f"""WITH {_P}
SELECT path, 'fastapi.router.get' AS rule_id, 'http.route' AS kind, 'GET' AS method, '/parts/:id/' || p_size AS route, NULL AS op, NULL AS table_name FROM p WHERE p_partkey % 4 = 0
UNION ALL SELECT path, 'fastapi.raw_sql', 'db.sql', NULL, NULL, 'SELECT', 't' || p_size FROM p WHERE p_partkey % 4 = 0
UNION ALL SELECT path, 'express.app.method', 'http.route', 'POST', '/p' || k || '/:id', NULL, NULL FROM p WHERE p_partkey % 4 = 2"""
)
def graph_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("normalized_values")
    return built(spark, sf_dir).effects.select("path", "rule_id", "kind", v["method"].alias("method"), v["path"].alias("route"), v["op"].alias("op"), v["table"].alias("table_name"))


_FACTS = [
    (0, "ASSIGN", "base_url", "lit:@b", "FOLDED", 0), (3, "CALL_NORM", "path", "lit:@b/c+d/{x}", "NON_LITERAL_PATH", 0), (3, "ASSIGN", "url", "lit:h{x}", "FOLDED,NON_LITERAL_PART", 1),
    (3, "ASSIGN", "table_t", "dyn:{x}", "DYNAMIC", 2), (3, "USE", "path", "var:path", "", 3),
]


@query(_by_shape("op_kind name src flags seq", [(row[0], *[_q(x) for x in row[1:-1]], str(row[-1])) for row in _FACTS]))
def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).facts.select("path", "op_kind", "name", "src", F.array_join("flags", ",").alias("flags"), "seq")


#: By shape: control words of each function.
_WORDS = [(0, "if return return"), (0, "return"), (1, "return"), (1, "async for yield"), (2, "return"), (2, "if return"), (3, "return")]
_LABELLED, _JUMPS = ("if",), ("return",)
_FLOW = [(s, w.split()) for s, w in _WORDS]
_FLOW = [(s, len(w), len(w) + sum(x in _LABELLED for x in w) + sum(x in _JUMPS for x in w) + 1) for s, w in _FLOW]


@query(f"WITH {_P} SELECT blocks, edges, count(*) AS functions FROM (" + " UNION ALL ".join(f"SELECT {n + 2}::BIGINT AS blocks, {e}::BIGINT AS edges FROM p WHERE p_partkey % 4 = {s}" for s, n, e in _FLOW) + ") GROUP BY blocks, edges")
def graph_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and edges per function: with n control words 2 + n, and n + labelled + jumps + 1."""
    g = built(spark, sf_dir)
    edges = g.cfg_edges.groupBy("fn_id").agg(F.count("*").alias("edges"))
    per = g.cfg_blocks.groupBy("fn_id").agg(F.count("*").alias("blocks")).join(edges, "fn_id")
    return per.groupBy("blocks", "edges").agg(F.count("*").alias("functions"))


_REFS = {0: ("g@z", "router", "session"), 1: ("g", "f@z", "h@z", "i", "a@k"), 2: ("mix", "d", "x", "g@z", "app"), 3: ("os", "build", "load", "open", "fetch@z")}


@query(
    f"WITH {_P}, r AS ({' UNION ALL '.join(f'SELECT {int(s == 2)} AS script, {_q(n)} AS name FROM p WHERE p_partkey % 4 = {s}' for s, names in _REFS.items() for n in names)}) "
    "SELECT (SELECT sum(CASE p_partkey % 4 WHEN 3 THEN 1 ELSE 3 END) FROM p)::BIGINT AS definitions, (SELECT count(*) FROM (SELECT DISTINCT script, name FROM r)) AS callees, (SELECT sum(CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END) FROM p)::BIGINT AS imported"
)
def graph_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    counts = {"definitions": ~kind.isin("symbol.ref", "import.symbol"), "callees": kind == "symbol.ref", "imported": kind == "import.symbol"}
    return built(spark, sf_dir).symbols.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


@query(f"WITH {_P} SELECT path, 'UNCERTAIN_BINDING' AS anomaly_type, 'WARN' AS severity, 'from ... import *' AS reason_detail FROM p WHERE p_partkey % 4 = 3 UNION ALL SELECT NULL, 'PARSE_ERROR', 'WARN', 'Rule pack not loaded: none'")
def graph_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).anomalies


def _metric_rows(*rows: tuple[int, ...]) -> list[tuple]:
    return [(s, *[f"{n}::BIGINT" for n in row]) for s, row in enumerate(rows)]


@query(_by_shape("defs calls imports exports literals", _metric_rows((3, 3, 2, 0, 3), (3, 8, 1, 0, 2), (3, 5, 1, 1, 3), (1, 5, 2, 0, 3))))
def lift_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of each file; chained calls count one by one."""
    return built(spark, sf_dir).metrics_of("defs", "calls", "imports", "exports", "literals")


@query(_by_shape("imports_seen imports_resolved alias_edges local_refs", _metric_rows((2, 4, 4, 0), (1, 1, 1, 1), (1, 2, 2, 0), (2, 3, 3, 0))))
def bind_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).metrics_of("imports_seen", "imports_resolved", "alias_edges", "local_refs")


@query(_by_shape("blocks flow_edges facts", _metric_rows(*[(sum(n + 2 for s, n, _ in _FLOW if s == k), sum(e for s, _, e in _FLOW if s == k), sum(r[0] == k for r in _FACTS)) for k in range(4)])))
def flow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).metrics_of("blocks", "flow_edges", "facts")


@query(_by_shape("candidate_calls matched fields_missing pack_errors", _metric_rows((3, 2, 0, 1), (7, 0, 0, 1), (5, 1, 0, 1), (5, 0, 0, 1))))
def detect_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).metrics_of("candidate_calls", "matched", "fields_missing", "pack_errors")


@query("SELECT 'fastapi' AS tag, count(*) * 2 AS matched, count(DISTINCT p_partkey) AS files FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'express', count(*), count(*) FROM part WHERE p_partkey % 4 = 2")
def detect_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects and files of each telemetry tag."""
    return built(spark, sf_dir).effects.groupBy("tag").agg(F.count("*").alias("matched"), F.countDistinct("path").alias("files"))


# ------------------------------------------------ sources that need the machine

#: Source texts by p_partkey % 3: TypeScript, Python, JSX.
HARD = (
    r'''abstract class A@k<T> extends B {
  constructor(private a: string, b?: Map<string, Array<T>>) { init@z(a) }
  public static async q(x: string): Promise<void> {
    return g(`a ${h@z(x)} ${`n ${i(2)}`}`)
  }
  get y() { return 1 }
  abstract p(x: number): { a: string };
  protected r(a = s(1, [2, {b: (3)}])): { b: number } | null {
    const re = /"[/]'/g.test(t@k(a)) ? u / v / w(4) : 1;
    return k("a\
b") + l(`C:\\`)
  }
}
interface I {
  m(a: string): void;
  n(): string
}
const z = y ? f(@z) : { a: 1 };
const c = items
  .map<U@k, Array<T>>(one)
  ?.filter(two, ...rest(@z));
o?.p?.(5)
''',
    r'''x = """a@z\\"""
f@k(1)
s = 'it\'s' + g(r"\\", 2)  # "h(3)
t = (df@k.a
    .select(1)  # .b(2)

    .where(3))
def m(a, b=(1, (2, (3, (4, (5, 6)))))):
    return i(@z)
''',
    """function App@k() {
  const s = a /b/ c(1);
  return <div title="it's {x(1)" onClick={() => f@z(2)}>don't call(3) {g(4)}<b>it's</b><br/></div>;
}
h@k(5)
""",
)


def hard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, which = parts_of(spark, sf_dir), F.col("p_partkey") % 3
    text = F.element_at(F.array(*[F.lit(x) for x in HARD]), (which + 1).cast("int"))
    for mark, column in (("@k", "p_partkey"), ("@z", "p_size")):
        text = F.replace(text, F.lit(mark), F.col(column).cast("string"))
    ending = F.when(which == 0, ".ts").when(which == 1, ".py").otherwise(".jsx")
    language = F.when(which == 0, "typescript").when(which == 1, "python").otherwise("javascript")
    return parts.select(F.concat(F.lit("hard/p"), F.col("p_partkey").cast("string"), ending).alias("path"), language.alias("language"), text.alias("text"))


def _hard(columns: str, rows: list[tuple]) -> str:
    """SQL of rows (shape, one text for each column)."""
    p = "p AS (SELECT *, 'hard/p' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.jsx' END AS path, p_partkey::VARCHAR AS k, p_size::VARCHAR AS z, p_brand AS b FROM part)"
    names = columns.split()
    return f"WITH {p} " + " UNION ALL ".join(f"SELECT path, {', '.join(f'{_q(v)} AS {n}' for n, v in zip(names, row[1:], strict=True))} FROM p WHERE p_partkey % 3 = {row[0]}" for row in rows)


def _cut(files: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """``column``: the bytes of the rows' spans."""
    text = F.decode(F.substr(F.encode("text", "UTF-8"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    return rows.join(files.select("path", "text"), "path").withColumn(column, text)


_HARD_CALLS = [
    (0, "init@z", "init@z(a)", "a"), (0, "g", "g(`a ${h@z(x)} ${`n ${i(2)}`}`)", "`a ${h@z(x)} ${`n ${i(2)}`}`"), (0, "s", "s(1, [2, {b: (3)}])", "1|[2, {b: (3)}]"), (0, "test", ".test(t@k(a))", "t@k(a)"), (0, "w", "w(4)", "4"),
    (0, "k", 'k("a\\\nb")', '"a\\\nb"'), (0, "l", "l(`C:\\\\`)", "`C:\\\\`"), (0, "f", "f(@z)", "@z"),
    (0, "items.map", "items\n  .map<U@k, Array<T>>(one)\n  ?.filter(two, ...rest(@z))", "one"), (0, "o.p", "o?.p?.(5)", "5"), (1, "df@k.a.select", "df@k.a\n    .select(1)  # .b(2)\n\n    .where(3)", "1"),
    (1, "f@k", "f@k(1)", "1"), (1, "g", 'g(r"\\\\", 2)', 'r"\\\\"|2'), (1, "i", "i(@z)", "@z"),
    (2, "c", "c(1)", "1"), (2, "f@z", "f@z(2)", "2"), (2, "g", "g(4)", "4"), (2, "h@k", "h@k(5)", "5"),
]


@query(_hard("callee preview args", _HARD_CALLS))
def lexer_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls over lines, in holes of templates, after regular expressions, escapes and strings over lines, and between elements' texts."""
    files = hard_files(spark, sf_dir)
    return _cut(files, captures.call_groups(*captures.read(files).stages), "preview").select("path", "callee", "preview", F.array_join("args", "|").alias("args"))


_HARD_TEXTS = [
    (0, "lit.template", "`a ${h@z(x)} ${`n ${i(2)}`}`"), (0, "lit.template", "`n ${i(2)}`"), (0, "lit.string", '"a\\\nb"'), (0, "lit.template", "`C:\\\\`"),
    (1, "lit.string", '"""a@z\\\\"""'), (1, "lit.string", "'it\\'s'"), (1, "lit.string", '"\\\\"'), (2, "lit.string", '"it\'s {x(1)"'),
]


@query(_hard("kind text", _HARD_TEXTS))
def lexer_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = hard_files(spark, sf_dir)
    return _cut(files, captures.literals(stage_table(captures.lines(files), "lines")).drop("text"), "text").select("path", "kind", "text")


_HARD_DEFS = [
    (0, "A@k", "A@k(0)||class", "abstract class", "\n}"), (0, "constructor", "constructor(2)|string,Map|", "constructor(pr", " }"), (0, "q", "q(1)|string|async", "public static ", " }"), (0, "y", "y(0)||getter", "get y() { retu", " }"),
    (0, "p", "p(1)|number|", "abstract p(x: ", " }"), (0, "r", "r(1)|?|", "protected r(a ", " }"), (0, "m", "m(1)|string|", "m(a: string): ", "id"), (0, "n", "n(0)||", "n(): string", "ng"),
    (1, "m", "m(2)|?,?|", "def m(a, b=(1,", ")\n"), (2, "App@k", "App@k(0)||", "function App@k()", "\n}"),
]


@query(_hard("name signature begins ends", _HARD_DEFS))
def lexer_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods with types, signatures of interfaces and abstract methods, and where they begin and end."""
    files = hard_files(spark, sf_dir)
    found = _cut(files, captures.definitions(*captures.read(files).stages), "whole")
    signature = graph.signature(F.col("header"), F.col("language"), None, F.col("params"))
    begins = F.when(F.col("language") == "javascript", F.regexp_extract("whole", r"^[^)]*\)", 0)).otherwise(F.left("whole", F.lit(14)))
    return found.select("path", "name", signature.alias("signature"), begins.alias("begins"), F.right("whole", F.lit(2)).alias("ends"))


#: Text under an encoding, and what is told of it, by p_partkey % 6; a number follows each.
ENCODED = (
    ("koi8-r", "Привет, это обычный русский текст с несколькими словами, чтобы было что считать. Он длинный: сто двадцать восемь байтов. "),
    ("windows-1251", "Привет, это обычный русский текст с несколькими словами, чтобы было что считать. Он длинный: сто двадцать восемь байтов. "),
    ("shift_jis", "これは日本語の文章です。文字コードを判定するために、ひらがなとカタカナと漢字を使っています。もう少し長くします。 "),
    ("euc_jp", "これは日本語の文章です。文字コードを判定するために、ひらがなとカタカナと漢字を使っています。もう少し長くします。 "),
    ("iso-8859-1", "Le café d'à côté était fermé, et l'élève préférait déjà être à l'école où il a été reçu; ça ne gêne personne, même à Noël, bien sûr. "),
    ("utf-8", "Le café d'à côté était fermé. Привет. 日本語 "),
)


@query("SELECT p_partkey, CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(ENCODED)) + " END AS encoding FROM part")
def encodings_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = parts_of(spark, sf_dir)
    known = F.array(*[F.lit((text * 2).encode(name)) for name, text in ENCODED])
    content = F.concat(F.element_at(known, (F.col("p_partkey") % 6 + 1).cast("int")), F.encode(F.col("p_partkey").cast("string"), "US-ASCII"))
    return encodings.with_encoding(parts.select("p_partkey", content.alias("content"))).select("p_partkey", "encoding")


@query("SELECT p_partkey, (2 + p_size + least(p_size, p_partkey % 7))::INTEGER AS nodes, abs(p_size - p_partkey % 7)::BIGINT AS errors FROM part")
def forest_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (a file, a statement, names that are called, pairs of brackets) and brackets without a partner."""
    opened, closed = F.col("p_size"), (F.col("p_partkey") % 7).cast("int")
    text = F.concat(F.repeat(F.lit("f("), opened), F.lit("x"), F.repeat(F.lit(")"), closed))
    rows = captures.lines(parts_of(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("path"), F.lit("python").alias("language"), text.alias("text")))
    rows = stage_table(rows, "lines")
    found = stage_table(captures.tokens(rows), "tokens")
    return captures.forest(rows, found, captures.brackets(found)).select(F.col("path").cast("long").alias("p_partkey"), F.col("nodes").cast("int").alias("nodes"), F.col("errors").cast("long").alias("errors"))


# ----------------------------------------------- expressions over derived code


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'BINARY' WHEN o_orderkey % 11 = 0 THEN 'ERROR' WHEN o_orderkey % 100 * 1000000 > 52428800 THEN 'TOO_LARGE'
  WHEN o_orderkey % 100 * 1000000 >= 10485760 AND o_orderkey % 3 = 0 THEN 'PATHOLOGICAL'
  WHEN o_custkey * 100 > 50000 AND (o_orderkey % 9000) / least(o_custkey * 100, 50000) >= 0.1 THEN 'PARTIAL' ELSE 'OK' END AS status FROM orders"""
)
def parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text, signs = F.when(key % 11 != 0, F.lit("t")), F.when(key % 3 == 0, F.lit("minified")).otherwise(F.lit(""))
    status = discovery.parse_status(text, key % 100 * 1_000_000, key % 13 == 0, signs, F.col("o_custkey") * 100, key % 9000)
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@query(
    """SELECT page_id, CASE WHEN octet_length(encode(url)) * 20 >= 256
  THEN len(regexp_extract_all(url, '[\\x09\\x0A\\x0D\\x20-\\x7E]')) * 20 / (octet_length(encode(url)) * 20) ELSE 1.0 END::DOUBLE AS share FROM pages"""
)
def printable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.repeat("url", F.lit(20)), "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", discovery.printable_share(content).cast("double").alias("share"))


_CALL = (
    "CASE p_partkey % 5 WHEN 0 THEN concat('os.path.join(\"', p_brand, '\", name, \"f.txt\")') WHEN 1 THEN concat('path.join(\"/a/\", \"', p_brand, '\")') "
    "WHEN 2 THEN concat('new URL(\"/v/', p_size, '\", \"https://h.io\")') WHEN 3 THEN concat('URL(\"https://h/', p_size, '\")') ELSE concat('open(\"', p_brand, '\")') END"
)


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand || '/{x}/f.txt' WHEN 1 THEN '/a/' || p_brand WHEN 2 THEN 'https://h.io/v/' || p_size WHEN 3 THEN 'https://h/' || p_size END AS normal FROM part")
def call_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_call(F.expr(_CALL)).alias("normal"))


@query("SELECT p_partkey, p_brand || '|' || p_type AS literals FROM part")
def string_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.format_string("f('%s', x, \"%s\")", "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.string_literals(code), "|").alias("literals"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'f' || p_size || '(2)|?,int|' WHEN 1 THEN 'm' || p_size || '(1)|*|async' ELSE 'K' || p_size || '(0)||class' END AS signature FROM part")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('def f', p_size, '(a, b: int = g(1, 2)):') WHEN 1 THEN concat('async def m', p_size, '(self, *xs):') ELSE concat('class K', p_size, ':') END")
    return table(spark, sf_dir, "part").select("p_partkey", graph.signature(header, F.lit("python")).alias("signature"))


@query("SELECT p_partkey, 'f' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '(2)|?,int|' ELSE '(1)|?|async' END AS signature FROM part")
def decorated_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of headers with decorators, some over several lines."""
    header = F.expr("CASE p_partkey % 2 WHEN 0 THEN concat('@d(1, (2))\n\n  @e.f\ndef f', p_size, '(a,\n  b: int):') ELSE concat('@r.get(\n  \"/x\",\n)\nasync def f', p_size, '(x):') END")
    return table(spark, sf_dir, "part").select("p_partkey", graph.signature(header, F.lit("python")).alias("signature"))


@query("SELECT p_partkey, 'a' || p_size || ';g(1, 2);[x, {y, z}];k=' || p_partkey || ';\"p, q\"' AS args FROM part")
def split_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.format_string('a%d, g(1, 2), [x, {y, z}], k=%d, "p, q"', "p_size", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(captures.split_arguments(inside), ";").alias("args"))


@query("SELECT p_partkey, v.imported, v.alias, v.kind, 'm' || p_size AS module FROM part, (VALUES ('default', 'D', 'default'), ('a', 'b', 'named'), ('c', 'c', 'named')) v(imported, alias, kind)")
def script_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("import D, { a as b, c } from 'm%d'", "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(graph.script_imports(line)).alias("b")).select("p_partkey", "b.*")
