"""Discovery, packs, graph, store and streaming on small hand-written inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import text as T
from sourceloom.operators import discovery, effects, flow, graph, intervals
from sourceloom.plans import report, store
from sourceloom.sources import captures, files, rule_packs
from sourceloom.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def tree(root, content):
    for path, text in content.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def decide(spark, root, **options):
    return {r.rel_path: r.decision for r in discovery.decide(files.scan_tree(spark, root), discovery.Options(**options)).collect()}


def test_import_aliases(spark):
    rows = [
        (1, "python", "import os.path, sys as s, os"), (2, "python", "from a import (b as c,\n  c,\n  d)"), (3, "python", "from m import *"), (4, "python", None), (5, "python", "x = 1"),
        (6, "javascript", 'import D, { a as b, type C, D } from "m"'), (7, "typescript", 'import * as n from "m"'), (8, "javascript", 'import "m"'),
    ]
    df = spark.createDataFrame(rows, "id int, language string, statement string")
    got = {r.id: r.v for r in df.select("id", graph.import_aliases(F.col("statement"), F.col("language")).alias("v")).collect()}
    assert got == {1: ["os", "s"], 2: ["c", "d"], 3: [], 4: [], 5: [], 6: ["D", "b", "C"], 7: ["n"], 8: []}


def test_headers_without_decorators(spark):
    cases = {"@a\n@b.c(1, (2))\n\n  def f(x):": "def f(x):", '@r(\n "/x",\n)\ndef g():': "def g():", "def h(a=m @ n):": "def h(a=m @ n):", "@a": "@a", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.v for r in df.select("h", T.without_decorators(F.col("h")).alias("v")).collect()} == cases


def test_rules_by_language(spark):
    rule = ("p", "p", None, None, None, "io.file", "p", "f", 0.9, "call", "open", None, 0, None, [], None)
    rows = [(*rule[:2], name, language, pattern, *rule[5:]) for name, language, pattern in (("a", "any", "any"), ("b", "python", "any"), ("c", "any", "python"), ("d", "python", "javascript"))]
    listed = effects.by_language(spark.createDataFrame(rows, effects.RULE_SCHEMA)).groupBy("rule_id").agg(F.sort_array(F.collect_list("call_language")).alias("v"))
    got = {r.rule_id: r.v for r in listed.collect()}
    assert got["b"] == got["c"] == ["python"] and "d" not in got and {"javascript", "python", "typescript"} <= set(got["a"])


# ------------------------------------------------------------------- discovery


def test_languages_and_vendor(spark, tmp_path):
    root = tree(tmp_path, {"src/a.py": "print('hi')\n", "src/b.ts": "export const x = 1;\n", "src/c.jsx": "export default 1\n", "node_modules/lib.js": "x\n", "x.lock": "l", "z.md": "m"})
    got = decide(spark, root)
    assert got == {"src/a.py": "supported", "src/b.ts": "supported", "src/c.jsx": "supported", "node_modules/lib.js": "skipped_vendor", "x.lock": "skipped_deny_glob", "z.md": "skipped_unsupported"}
    decided = discovery.decide(files.scan_tree(spark, root))
    assert [tuple(r)[:3] for r in discovery.anomalies(decided).collect()] == [("node_modules/lib.js", "VENDORED_CODE", "INFO")]
    assert decide(spark, root, include_vendor=True)["node_modules/lib.js"] == "supported"


def test_minified_generated_globs_and_size(spark, tmp_path):
    root = tree(tmp_path, {"web/bundle.min.js": "var a=1", "web/long.js": "1" * 5000 + "\n", "gen/auto.ts": "// @generated\nexport const z=1;\n", "keep/ok.py": "1\n", "drop/bad.py": "0\n"})
    got = decide(spark, root)
    assert (got["web/bundle.min.js"], got["web/long.js"], got["gen/auto.ts"]) == ("skipped_minified", "skipped_minified", "skipped_generated")
    got = decide(spark, root, allow=("keep/**",), deny=("drop/**",), max_bytes=1)
    assert got["keep/ok.py"] == "oversize" and got["drop/bad.py"] == "skipped_deny_glob" and got["gen/auto.ts"] == "skipped_not_allowed"


def test_links(spark, tmp_path):
    outside = tmp_path / "outside"
    tree(outside, {"x.py": "secret\n"})
    root = tmp_path / "repo"
    tree(root, {"in.py": "ok\n"})
    (root / "x.py").symlink_to(outside / "x.py")
    (root / "gone.py").symlink_to(root / "nothing")
    (root / "again.py").symlink_to(root / "in.py")
    got = decide(spark, str(root))
    assert got == {"x.py": "symlink_out_of_root", "gone.py": "unreadable", "again.py": "supported", "in.py": "supported"}
    assert files.scan_tree(spark, str(root)).filter("rel_path = 'x.py'").first().text is None
    assert files.scan_tree(spark, str(root)).filter("rel_path = 'x.py'").first().read_error is False
    with pytest.raises(ValueError):
        files.list_tree(spark, str(root / "none"))


def test_binary_and_encodings(spark, tmp_path):
    root = tree(tmp_path, {"a.py": b"\xef\xbb\xbfx = 1", "b.py": b"\x00\x01bin", "c.py": "é = 1".encode("latin-1"), "d.py": "h = 'é'".encode("utf-16"), "e.png": b"text", "f.py": b"%PDF-1", "g.py": "k = 'é'".encode("utf-32"), "h.py": b"\x01\x02" * 150, "i.py": b"ok " * 40})
    scanned = files.scan_tree(spark, root, max_bytes=400)
    got = {r.rel_path: r.text for r in scanned.collect()}
    assert got == {"a.py": "x = 1", "b.py": None, "c.py": "é = 1", "d.py": "h = 'é'", "e.png": None, "f.py": None, "g.py": "k = 'é'", "h.py": None, "i.py": "ok " * 40}
    assert files.read_anomalies(scanned).count() == 0 and files.walk_anomalies(files.list_tree(spark, root)).count() == 0
    small = {r.rel_path: (r.text, r["size"], r.read_error) for r in files.scan_tree(spark, root, max_bytes=10).collect()}
    assert small["i.py"] == (None, 120, False) and small["a.py"][0] == "x = 1"
    made = report.discovery_report(discovery.decide(scanned), discovery.anomalies(discovery.decide(scanned))).first()
    assert made.tallies.files_seen == 9 and made.tallies.supported == 8


def closed_folder(path):
    if path.endswith("/closed"):
        raise PermissionError(13, "Permission denied", path)
    import os

    return os.scandir(path)


def closed_file(path):
    if path.endswith("closed.py"):
        raise PermissionError(13, "Permission denied", path)
    assert not path.endswith((".md", "skip.py"))  # passed over by their paths: never opened
    return files.read_bytes(path)


def test_what_cannot_be_listed_or_read_is_an_anomaly(spark, tmp_path):
    root = tree(tmp_path, {"a/b/c/d.py": "x = 1\n", "a/closed.py": "s", "closed/e.py": "e", "z.md": "m", "drop/skip.py": "n", "top.py": "t = 1\n", **{f"many/f{i}.py": "f()\n" for i in range(60)}})
    (tmp_path / "loop").symlink_to(tmp_path)
    listing = files.list_tree(spark, root, closed_folder)
    assert listing.filter("kind = 'folder'").count() == 7 and listing.filter("kind = 'file'").count() == 65
    assert [(r.path, r.anomaly_type) for r in files.walk_anomalies(listing).collect()] == [("closed", "PERMISSION_DENIED")]
    options = discovery.Options(deny=("drop/**",))
    scanned = files.scan_tree(spark, root, options=options, listing=listing, opener=closed_file)
    got = {r.rel_path: (r.text, r.read_error) for r in scanned.collect()}
    assert got["a/closed.py"] == (None, True) and got["a/b/c/d.py"] == ("x = 1\n", False) and got["z.md"] == got["drop/skip.py"] == (None, False) and got["many/f7.py"][0] == "f()\n"
    found = [tuple(r) for r in files.read_anomalies(scanned).collect()]
    assert [r[:3] for r in found] == [("a/closed.py", "READ_ERROR", "ERROR")] and found[0][3].startswith("Could not read: PermissionError")
    decided = discovery.decide(scanned, options)
    made = report.discovery_report(decided, discovery.anomalies(decided).union(files.walk_anomalies(listing)), listing.filter("kind = 'folder'").count()).first()
    assert (made.tallies.dirs_seen, made.tallies.files_seen, made.tallies.skipped_deny_glob, made.tallies.skipped_unsupported) == (7, 65, 1, 1)
    report.save_json(report.discovery_report(decided, discovery.anomalies(decided)), f"file://{tmp_path}/report")
    written = json.loads("".join(p.read_text() for p in (tmp_path / "report").glob("part-*")))
    assert written["tallies"]["parse_candidates"] == written["tallies"]["supported"] == 63


# ------------------------------------------------------------------------ text


@pytest.mark.parametrize(("path", "want"), [("/u/{id}/", "/u/:id"), ("/u/[...slug]", "/u/:slug"), ("/u/${id}", "/u/:id"), ("/u/:id<int>", "/u/:id"), ("//a//b", "/a/b"), ("/", "/"), ("", "")])
def test_http_paths(spark, path, want):
    assert one(spark, T.http_path(F.lit(path))) == want


@pytest.mark.parametrize(("text", "want"), [('k = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', 'k = ***7ff"'), ("a@b.co", "***"), ("4111 1111 1111 1111", "***1111"), ("x" * 201, "x" * 200 + "…"), (None, "")])
def test_redaction(spark, text, want):
    assert one(spark, T.redact_store(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("code", "want"), [("'https://h'", ("https://h", ["FOLDED"])), ("base + '/x'", ("{x}/x", ["FOLDED", "NON_LITERAL_PART"])), ("build()", ("dyn:{x}", ["DYNAMIC"])), ("'a' + b", ("a{x}", ["FOLDED", "NON_LITERAL_PART"]))])
def test_folding(spark, code, want):
    got = one(spark, T.fold_concat(F.lit(code)))
    assert (got.value, got.flags) == want


def test_nesting_and_globs(spark):
    assert one(spark, T.max_nesting(F.lit("([{}]))(("))) == 3
    for glob, path, want in (("**/*.py", "a/b.py", True), ("**/*.py", "b.py", False), ("a?[bc]", "axb", True), ("a[!b]", "ab", False), ("a.b", "axb", False)):
        assert one(spark, T.matches_any(F.lit(path), [glob])) == want


def test_imports_of_scripts(spark):
    cases = {
        'import D, { a as b, c } from "m"': [("m", "default", "D", "default"), ("m", "a", "b", "named"), ("m", "c", "c", "named")],
        "import * as n from 'q'": [("q", "*", "n", "namespace")],
        'import "z"': [("z", "*", "z", "star")],
        'const {p, r: t} = require("u")': [("u", "p", "p", "named"), ("u", "r", "t", "named")],
        'const w = require("v")': [("v", "*", "w", "module")],
    }
    for line, want in cases.items():
        assert [tuple(x) for x in one(spark, graph.script_imports(F.lit(line)))] == want


# ----------------------------------------------------------------------- packs


def test_built_in_packs(spark):
    registry = rule_packs.Registry()
    assert set(map(tuple, registry.load_folder().values())) == {()}
    assert {n: len(p["rules"]) for n, p in registry.packs.items()} == {"core@1": 1, "fastapi@0.115": 3, "express@4": 1, "sequelize@6": 1, "prisma@5": 1}
    assert registry.packs["express@4"]["requires"] == ["core@1"] and registry.table(spark).count() == 10


def test_invalid_packs(tmp_path):
    good = {"name": "p", "version": "1.0", "rules": [{"id": "r", "effect_kind": "cache", "provider": "x", "patterns": [{"kind": "call", "language": "any", "callee": "f"}]}]}

    def errors(**changes):
        path = tmp_path / "p.json"
        path.write_text(json.dumps(good | changes))
        return rule_packs.Registry().load(path)

    rule = good["rules"][0]
    assert errors() == []
    assert errors(version="2.0") and errors(rules=[]) and errors(rules=[rule, rule]) and errors(language="cobol")
    for change in ({"confidence": 0}, {"confidence": 1.5}, {"patterns": []}, {"effect_kind": "none"}, {"patterns": [{"kind": "odd"}]}, {"fields": [{"name": "n", "source": "odd"}]}):
        assert errors(rules=[rule | change])


def test_reload_when_newer(tmp_path):
    import os

    path = tmp_path / "p.json"
    path.write_text(json.dumps({"name": "p", "rules": [{"id": "r", "effect_kind": "cache", "provider": "x", "patterns": [{"kind": "call"}]}]}))
    registry = rule_packs.Registry()
    registry.load(path)
    assert not registry.reload_if_newer("p", path)
    os.utime(path, (2e9, 2e9))
    assert registry.reload_if_newer("p", path)


# ----------------------------------------------------------------------- graph

PY = '''import os, sys as s
from a.b import (
    c as d,
    e,
)
from x import *

class A:
    def m(self, *xs):
        if xs:
            return 1
        for x in xs:
            pass
        else:
            return 0

    class B:
        def n(cls): ...

@router.get("/users/{id}")
def u(id, b: int):
    base_url = 'https://h'
    path = base_url + '/x'  # comment if
    session.execute("SELECT * FROM t")
    return base_url
'''
JS = """import D, { a as b } from "m";
function f(x, y) {
  if (x) { return g(x); }
}
app.post('/a//b/', h)
"""


@pytest.fixture(scope="module")
def built(spark):
    registry = rule_packs.Registry()
    registry.load_folder()
    rows = [("mod.py", "python", PY, "s1"), ("web.js", "javascript", JS, "s2")]
    return graph.build(spark.createDataFrame(rows, "path string, language string, text string, blob_sha256 string"), registry.table(spark))


def test_definitions_and_scopes(built):
    names = {r.qualified_name: r.semantic_type for r in built.nodes.filter("semantic_type IN ('Class', 'Function', 'Method')").collect()}
    assert names == {"mod.py::A": "Class", "mod.py::A::m": "Method", "mod.py::A::B": "Class", "mod.py::A::B::n": "Method", "mod.py::u": "Function", "web.js::f": "Function"}
    assert built.symbols.filter("kind NOT IN ('symbol.ref', 'import.symbol')").count() == 6
    ids = [r.node_id for r in built.nodes.select("node_id").collect()]
    assert len(ids) == len(set(ids))


def test_spans_are_byte_exact(spark):
    rows = captures.lines(spark.createDataFrame([("m.py", "python", "x = 'é'\ndef f():\n    pass\ny = 1\n")], "path string, language string, text string"))
    d = captures.definitions(rows).first()
    raw = "x = 'é'\ndef f():\n    pass\ny = 1\n".encode()
    assert raw[d.start : d.end] == b"def f():\n    pass"


def test_bindings(built):
    got = {tuple(r) for r in built.bindings.select("path", "module", "imported", "alias", "kind").collect()}
    assert {("mod.py", "os", None, "os", "module"), ("mod.py", "sys", None, "s", "module"), ("mod.py", "a.b", "c", "d", "named"), ("mod.py", "a.b", "e", "e", "named"), ("mod.py", "x", "*", "*", "star")} <= got
    assert {("web.js", "m", "default", "D", "default"), ("web.js", "m", "a", "b", "named")} <= got
    assert [(r.path, r.anomaly_type, r.reason_detail) for r in built.anomalies.collect()] == [("mod.py", "UNCERTAIN_BINDING", "from ... import *")]


def test_effects(built):
    got = {r.rule_id: (r.kind, dict(r.normalized_values)) for r in built.effects.collect()}
    assert got == {
        "fastapi.router.get": ("http.route", {"method": "GET", "path": "/users/:id"}),
        "fastapi.raw_sql": ("db.sql", {"op": "SELECT", "table": "t"}),
        "express.app.method": ("http.route", {"method": "POST", "path": "/a/b"}),
    }
    owner = built.effects.filter("rule_id = 'fastapi.raw_sql'").join(built.nodes, F.col("owner_fn_id") == F.col("node_id")).first()
    assert owner.name == "u"


def test_facts(built):
    got = {(r.op_kind, r.dst, r.src, tuple(r.flags)) for r in built.facts.collect()}
    assert got == {("ASSIGN", "var:base_url", "lit:https://h", ("FOLDED",)), ("ASSIGN", "var:path", "lit:{x}/x", ("FOLDED", "NON_LITERAL_PART"))}


def test_flow_law(built, spark):
    tokens = [("f", p, k) for p, k in enumerate(["if", "return", "for", "else", "return"])]
    rows = spark.createDataFrame(tokens, "fn_id string, pos long, keyword string")
    n = flow.counts(rows).first()
    assert (n.blocks, n.edges) == (7, 10) and flow.edges(rows).count() == 10
    assert flow.edges(rows, cap=4).filter("kind = 'seq'").count() == 2
    assert built.cfg_edges.filter("kind = 'branch'").count() >= 2


def test_call_islands(spark):
    spans = [("p", 0, 6, "f"), ("p", 2, 5, "g"), ("p", 6, 10, "h"), ("p", 12, 14, "k")]
    got = intervals.island_spans(spark.createDataFrame(spans, "path string, start long, end long, name string"), ["path"], "start", "end", "name").orderBy("island").collect()
    assert [(r.start, r.end, r.members) for r in got] == [(0, 10, 3), (12, 14, 1)]


def test_bins_give_the_same_containment(spark):
    import random

    r = random.Random(2)
    rows = [(i, "p", s := r.randrange(500), s + r.randrange(200)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, path string, start long, end long")
    plain, binned = (sorted(map(tuple, intervals.parents(df, ["path"], "id", bins=b).collect())) for b in (None, 50))
    assert plain == binned


def test_missing_packs(spark):
    rules = spark.createDataFrame([("a",)], "pack string")
    got = effects.missing_packs(spark.createDataFrame([("a",), ("b",)], "pack string"), rules).collect()
    assert [(r.pack, r.severity) for r in got] == [("b", "WARN")]


# --------------------------------------------------------------- report, store


def test_percentiles_and_report(spark):
    times = spark.createDataFrame([(1,), (2,), (10,), (None,)], "parse_time_ms long")
    assert tuple(report.parse_times(times).first()) == (2, 9)
    states = spark.createDataFrame([("hit",), ("hit",), ("miss",), (None,)], "cache_state string")
    assert {tuple(r) for r in report.cache_states(states).collect()} == {("hit", 2), ("miss", 1), ("unknown", 1)}
    assert states.agg(report.hit_ratio()).first()[0] == 0.5


def document(results, folder):
    """The written parts of a document, joined in the order of their names."""
    report.save_sarif(results, f"file://{folder}")
    return json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))


def test_sarif_of_many_ties_and_of_none(spark, tmp_path):
    rows = spark.range(500).selectExpr("'p' path", "'X' anomaly_type", "'WARN' severity", "IF(id < 400, NULL, 'd') reason_detail", "CAST(id % 3 AS INT) ts", "CAST(NULL AS array<struct<line_start:int,col_start:int,line_end:int,col_end:int>>) spans", "'s' blob_sha256").repartition(7)
    found = document(report.sarif_results(rows, ["WARN"]), tmp_path / "many")["runs"][0]["results"]
    assert len(found) == 500 and [r["properties"]["timestamp"] for r in found] == sorted(r["properties"]["timestamp"] for r in found)
    assert {r["message"]["text"] for r in found} == {"X:", "X: d"} and found[0]["properties"]["blob_sha256"] == "s"
    assert document(report.sarif_results(rows, ["ERROR"]), tmp_path / "none")["runs"][0]["results"] == []


def test_sarif(spark, tmp_path):
    rows = [("p", "X", "WARN", "m", 2, [(0, 4, 1, 2)]), ("q", "Y", "ERROR", "n", 1, None), ("r", "Z", "INFO", "o", 0, None)]
    df = spark.createDataFrame(rows, "path string, anomaly_type string, severity string, reason_detail string, ts long, spans array<struct<line_start:int,col_start:int,line_end:int,col_end:int>>")
    doc = document(report.sarif_results(df, ["WARN", "ERROR"]), tmp_path / "two")
    results = doc["runs"][0]["results"]
    assert [r["ruleId"] for r in results] == ["UCG.Y", "UCG.X"] and [r["id"] for r in doc["runs"][0]["tool"]["driver"]["rules"]] == ["UCG.X", "UCG.Y"]
    assert results[1]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 5, "endLine": 2, "endColumn": 3}


def test_store_replaces_files(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.read("nodes").count() == 0

    def nodes(rows):
        return spark.createDataFrame(rows, "repo_id string, run_id string, path string, node_id string, name string")

    s.put("nodes", nodes([("r", "1", "a", "n1", "x"), ("r", "1", "a", "n1", "y"), ("r", "1", "b", "n2", "z")]), "name")
    s.put("nodes", nodes([("r", "1", "a", "n3", "w")]))
    assert {(r.path, r.node_id, r.name) for r in s.read("nodes").collect()} == {("a", "n3", "w"), ("b", "n2", "z")}
    bad = spark.createDataFrame([("r", "1", "a", 1)], "repo_id string, run_id string, path string, parse_time_ms long").withColumn("blob_sha256", F.lit("s"))
    s.put("metrics", bad)
    s.put("metrics", bad.withColumn("parse_time_ms", F.lit(5)))
    assert [r.parse_time_ms for r in s.read("metrics").collect()] == [5]
    before = s.manifest()
    with pytest.raises(Exception, match="lost"):
        s.put_all({"files": nodes([("r", "1", "c", "n", "x")]), "edges": spark.range(1).select(F.raise_error(F.lit("lost")).cast("string").alias("path"))})
    assert s.manifest() == before and s.read("files").count() == 0  # all tables or none
    s.put("nodes", nodes([("r", "1", f"f{i}", f"n{i}", "x") for i in range(200)]))
    named = dict(s.manifest()["nodes"])
    s.put("nodes", nodes([("r", "1", "f7", "n7", "y")]))
    assert sum(named[b] != f for b, f in s.manifest()["nodes"].items()) == 1 and s.read("nodes").count() == 202
    s.vacuum()
    assert s.read("nodes").count() == 202 and len(s._list(f"{s.folder}/manifests")) == 1


def test_stream_of_changed_files(spark, tmp_path):
    source, s = str(tmp_path / "in"), store.Store(spark, f"file://{tmp_path}/store")
    schema = "repo_id string, run_id string, path string, blob_sha256 string"

    def run():
        rows = spark.readStream.schema(schema).parquet(source)
        incremental.follow(rows, s, lambda b: {"files": b.withColumn("rel_path", F.col("path"))}, str(tmp_path / "ck")).awaitTermination(120)

    spark.createDataFrame([("r", "1", "a", "s1"), ("r", "1", "b", "s2")], schema).write.parquet(source)
    run()
    spark.createDataFrame([("r", "1", "a", "s3")], schema).write.mode("append").parquet(source)
    run()
    assert {(r.path, r.blob_sha256) for r in s.read("files").collect()} == {("a", "s3"), ("b", "s2")}


def test_cache_probe(spark):
    files_ = spark.createDataFrame([("a", "s1", "g", "q"), ("a", "s2", "g", "q")], "path string, blob_sha256 string, grammar_fp string, query_fp string")
    got = {r.blob_sha256: r.cache_state for r in incremental.split_cached(files_, files_.limit(1).union(files_.filter("blob_sha256 = 's1'"))).collect()}
    assert got["s1"] == "hit"


def test_imports_over_many_lines(spark):
    names = [f"n{i}" for i in range(60)]
    python = "x = f(\n  1)\nfrom a.b import (  # (all\n" + "".join(f"    {n} as m_{n},  # of {n})\n" for n in names) + ")  # end\nimport os\nfrom c import (\n    never,\n"
    script = "import D, {\n" + "".join(f"\t{n} as m_{n}, // of {n} }}\n" for n in names) + "} from \"m\";\nimport { a } from 'https://q';\nimport type {\n  T /* a type */\n} from 't';\nconst f = () => {\n};\n"
    table = spark.createDataFrame([("a.py", "python", python), ("b.ts", "typescript", script)], "path string, language string, text string")
    found = captures.imports(captures.lines(table)).orderBy("path", "line_no").collect()
    text = {"a.py": python, "b.ts": script}
    assert [text[r.path][r.start : r.end].split("\n")[-1] for r in found] == [")", "import os", "from c import (", "} from \"m\";", "import { a } from 'https://q';", "} from 't';"]
    got = [[tuple(x) for x in one(spark, (T.python_imports if r.language == "python" else graph.script_imports)(F.lit(r.statement)))] for r in found]
    assert got[0] == [("a.b", n, f"m_{n}", "named") for n in names] and got[1] == [("os", None, "os", "module")]
    assert got[3] == [("m", "default", "D", "default")] + [("m", n, f"m_{n}", "named") for n in names]
    assert got[4] == [("https://q", "a", "a", "named")] and [x[:3] for x in got[5]] == [("t", "T", "T")]


@pytest.mark.parametrize("name", ["koi8-r", "windows-1251", "shift_jis", "euc_jp", "iso-8859-1"])
def test_encodings_are_told_apart(spark, tmp_path, name):
    from sourceloom.code_queries import ENCODED
    from sourceloom.sources import encodings

    sample = dict(ENCODED)[name]
    assert encodings.detect((sample * 2).encode(name))[0] == name
    code = "".join(f"def function_number_{i}(argument, other=None):  # {sample[:14]}\n    return argument + {i} * (other or 0)\n" for i in range(12))
    root = tree(tmp_path, {"a.py": code.encode(name), "b.py": sample[:20].encode(name)})
    got = {r.rel_path: r.text for r in files.scan_tree(spark, root).collect()}
    assert got["a.py"] == code and got["b.py"] == sample[:20].encode(name).decode("latin-1")


def test_encodings_of_odd_bytes():
    from sourceloom.sources import encodings

    assert encodings.detect(b"") == ("utf-8", 1.0) and encodings.detect(b"abc\xe9")[0] == "iso-8859-1" and encodings.detect(b"\xff\xfea\x00")[0] == "utf-16-le" and encodings.detect(b"\xef\xbb\xbfa")[0] == "utf-8-sig"
    assert encodings.detect(bytes(range(256)) * 4)[0] in encodings.ENCODINGS
    assert encodings.detect("é".encode() * 40_000)[0] == "utf-8"  # a sample that cuts a letter
    assert encodings.detect(("x='é'\n" * 40).encode("latin-1"))[0] == "iso-8859-1"
