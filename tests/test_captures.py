"""Captures, signatures, effects' fields and anomalies on small awkward sources."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import text as T
from sourceloom.operators import effects, graph
from sourceloom.sources import captures, rule_packs

CALLS = r"""é = f(1) + f(2)
xfoo = 1 + foo(2)
y = a // g(3)
'''
if h(1): return
'''
s = "k(1)"  # k(2)
t = p(q(r(s([1, (2, 3)], x="é,("))),
  z=v(1),
).w( 1 )
f().g(2).h()
"""
SCRIPT = r"""/* a(1)
if b(2) */ c(3); // d(4)
`e(5) ${f(6)}
 return` + "g(7) \" h(8)";
x = i(9) // j(10)
"""
DOC = '''def f():
    """if x:
return 1 \'\'\' while
    """
    # for
# out
    return "else"'''
CLASS = """class K extends mix(B) {
  constructor(a) { this.a = a; }
  static async get(x,
    y = (z) => w(z)) {
    if (x) { return y(x) }
  }
}
const h = (p, q) => {
  return p
};
"""


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lined(spark, text, language="python"):
    return captures.lines(spark.createDataFrame([("f", language, text)], "path string, language string, text string"))


def called(table, text):
    raw = text.encode()
    return [(r.callee, r.preview, r.args, dict(r.kwargs), raw[r.start : r.end].decode()) for r in captures.call_groups(table).orderBy("start").collect()]


def test_calls_are_byte_exact(spark):
    calls = called(lined(spark, CALLS), CALLS)
    assert all(preview == cut for _, preview, _, _, cut in calls)
    assert [c[0] for c in calls] == ["f", "f", "foo", "g", "p", "f"]
    assert calls[4][2] == ['q(r(s([1, (2, 3)], x="é,(")))', "z=v(1)"] and calls[4][3] == {"z": "v(1)"} and calls[4][1].endswith("\n).w( 1 )")
    assert calls[5][1] == "f().g(2).h()"


def test_comments_and_strings_by_language(spark):
    table = lined(spark, SCRIPT, "javascript")
    assert [c[0] for c in called(table, SCRIPT)] == ["c", "f", "i"]
    assert captures.control_words(captures.tokens(table)).count() == 0
    table = lined(spark, DOC + "\nx = 1\n")
    assert [r.keyword for r in captures.control_words(captures.tokens(table)).collect()] == ["return"]
    d = captures.definitions(table).first()
    assert (d.start, d.end) == (0, len(DOC))


def test_methods_and_headers(spark):
    table = lined(spark, CLASS, "typescript")
    got = {r.name: (r.kind, r.header, CLASS.encode()[r.start : r.end].decode()) for r in captures.definitions(table).collect()}
    assert set(got) == {"K", "constructor", "get", "h"} and got["constructor"][2] == "constructor(a) { this.a = a; }"
    assert got["get"][1].endswith("w(z)) {") and got["get"][2].endswith("return y(x) }\n  }") and got["K"][2].endswith("}\n}") and got["h"][2].endswith("};")
    assert [c[0] for c in called(table, CLASS)] == ["mix", "w", "y"]


@pytest.mark.parametrize(
    ("header", "language", "want"),
    [
        ("def f(a, *b, c: Dict[str, int] = {1: 2}, **d):", "python", "f(4)|?,*,Dict,**|"), ("async def g(self, a):", "python", "g(1)|?|async"), ("class A(B):", "python", "A(0)||class"),
        ("const h = async (p: Map<string, X>, q) => {", "typescript", "h(2)|Map,?|arrow"), ("get size() {", "javascript", "size(0)||getter"), ("function* it(a) {", "javascript", "it(1)|?|"),
    ],
)
def test_signatures(spark, header, language, want):
    assert one(spark, graph.signature(F.lit(header), F.lit(language))) == want


def test_capped_captures_and_unknown_kinds(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "path string, start long")
    kept, over = captures.capped(rows, ["path"], "start", cap=3)
    assert kept.count() == 4 and [tuple(r) for r in over.collect()] == [("a", 2)]
    assert one(spark, captures.kind_of(F.lit("odd"))) is None and one(spark, captures.kind_of(F.lit("call.new"))).semantic == "Call"


def test_anomalies_of_odd_files(spark):
    python = "from q import\nx = 1\nfrom m import *\ndef f():\n" + "    if x: pass\n" * 2100 + "".join(f"    path{i} = 'v'\n" for i in range(600))
    rows = [("a.py", "python", python, "s"), ("b.js", "javascript", "const p = import('./z');\n", "s"), ("c.py", "python", "x = 1\n", "s"), ("d.py", "python", "\n", "s")]
    registry = rule_packs.Registry()
    registry.load_folder()
    g = graph.build(spark.createDataFrame(rows, "path string, language string, text string, blob_sha256 string"), registry.table(spark), ["core@1", "odd"])
    got = {(r.path, r.anomaly_type, r.reason_detail) for r in g.anomalies.collect()}
    assert got == {
        ("a.py", "UNCERTAIN_BINDING", "from ... import *"), ("a.py", "PARTIAL_PARSE", "CFG_BLOCK_CUTOFF"), ("a.py", "CONST_FOLD_CUTOFF", "facts>512"), ("a.py", "UNCERTAIN_BINDING", "Unparsed import preview for python"),
        ("b.js", "DYNAMIC_IMPORT", "dynamic import()"), ("c.py", "PARTIAL_PARSE", "AST present but no captures; check queries/grammar pin."), (None, "PARSE_ERROR", "Rule pack not loaded: odd"),
    }
    assert g.facts.count() == 512 and g.cfg_blocks.count() == 2000


def rules(spark, *patterns, fields=()):
    rows = [("p", None, f"r{i}", language, "any", "http.route", "x", "", 0.9, "call", callee, None, None, None, list(fields), glob) for i, (language, callee, glob) in enumerate(patterns)]
    return spark.createDataFrame(rows, effects.RULE_SCHEMA)


def test_fields_templates_and_globs(spark):
    schema = "call_id long, path string, language string, byte_start long, byte_end long, preview string, n_args int, args array<string>, kwargs map<string,string>, owner_fn_id string"
    calls = spark.createDataFrame([(1, "a/b.py", "python", 0, 9, "f('/x', 'y', k=3)", 3, ["'/x'", "'y'", "k=3"], {"k": "3"}, None)], schema)
    fields = [("path", "arg", 0, None, None), ("route", "literal", None, None, "/a/${1}/${kw:k}/${9}"), ("n", "literal", None, None, "one"), ("n", "literal", None, None, "two")]
    found = rules(spark, ("any", "f", None), ("javascript", "f", None), ("python", "f", T.glob_regex("*/c.py")), ("python", "f", T.glob_regex("a/*.py")), fields=fields)
    got = effects.detect(calls, found).collect()
    assert sorted(r.rule_id for r in got) == ["r0", "r3"]
    assert dict(got[0].literals) == {"path": "'/x'", "route": "/a/'y'/3/", "n": "two"} and dict(got[0].normalized_values)["path"] == "/a/'y'/3"


def test_rule_join_has_the_language_as_key(spark):
    calls = spark.createDataFrame([(1, "python", "f()", 0)], "call_id long, language string, preview string, n_args int")
    plan = effects.matched(calls, rules(spark, ("any", "f", None)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("code", "want"), [("'a+b' + \"c\"", "a+bc"), ("x + 'it\"s'", '{x}it"s'), ("1 + 2", "dyn:{x}")])
def test_folding_of_quoted_signs(spark, code, want):
    assert one(spark, T.fold_concat(F.lit(code))).value == want


def test_joined_paths_with_commas_in_quotes(spark):
    assert one(spark, T.normalize_call(F.lit("os.path.join('a,b', f(x, y), \"c\")"))) == "a,b/{x}/c"


def test_fingerprint_follows_the_patterns(monkeypatch):
    before = captures.fingerprint()
    assert before == captures.fingerprint() and len(before) == 64
    monkeypatch.setattr(captures, "_JS_CLASS", "other")
    assert captures.fingerprint() != before


def test_spans_that_are_none(spark):
    rows = spark.createDataFrame([(0, 0), (-1, 2), (3, 1), (2, 5)], "start long, end long")
    assert [tuple(r) for r in captures.sane(rows).collect()] == [(0, 0), (2, 5)]


def test_graph_tells_how_many_captures_a_file_loses(spark, monkeypatch):
    monkeypatch.setattr(graph.fixed, "CAPTURE_CAP", 2)
    registry = rule_packs.Registry()
    registry.load_folder()
    rows = [("a.py", "python", "f(1)\ng(2)\nh(3)\ni(4)\nj(5)\n", ""), ("b.py", "python", "f(1)\ng(2)\n", "")]
    g = graph.build(spark.createDataFrame(rows, "path string, language string, text string, blob_sha256 string"), registry.table(spark))
    assert [(r.path, r.reason_detail) for r in g.anomalies.filter("anomaly_type = 'CAPTURE_TRUNCATED'").collect()] == [("a.py", "calls: 3 captures dropped")]
    assert sorted((r.path, r.name) for r in g.nodes.filter("semantic_type = 'Call'").collect()) == [("a.py", "f"), ("a.py", "g"), ("b.py", "f"), ("b.py", "g")]
