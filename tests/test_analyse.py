"""From files to the stored tables: spans, replacement by file, batches that come again, streams that are killed."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import discovery
from sourceloom.plans import analyse, report, store
from sourceloom.sources import captures, rule_packs
from sourceloom.streaming import incremental

PY = '''# é
@router.get("/users/{id}")
def u(id, key="24be64439e3e49cf46b2d7c90f3602a3d0b907ff"):
    base_url = 'https://hé'; x = 1
    if id: session.execute("SELECT * FROM t")
    return f("24be64439e3e49cf46b2d7c90f3602a3d0b907ff",
             base_url)
'''
TS = "import { a } from 'm'; import * as b from 'n'\nclass K { m(x: string): void { a(x) } }\n"


@pytest.fixture(scope="module")
def rules(spark):
    registry = rule_packs.Registry()
    registry.load_folder()
    return registry.table(spark)


def files(spark, rows):
    return spark.createDataFrame(rows, "rel_path string, text string")


@pytest.fixture(scope="module")
def kept(spark, rules, tmp_path_factory):
    s = store.Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    rows = [("a.py", PY), ("k.ts", TS), ("vendor/v.py", "f(1)\n"), ("x.md", "text"), ("empty.py", ""), ("open.py", "f((((\n" * 10)]
    made = analyse.analyse(files(spark, rows), rules, "repo", "one", ["fastapi@0.115", "odd"], git_tree_sha="t")
    assert s.put_all(made.tables, files=made.files, batch=("b", 0)) and not s.put_all(made.tables, files=made.files, batch=("b", 0))
    made.discard()
    return s


def test_every_table_is_filled_and_keys_hold(kept):
    for table, (_, keys) in store.TABLES.items():
        rows = kept.read(table)
        assert rows.count() > 0, table
        assert not keys or rows.select(*keys).distinct().count() == rows.count()
        if "spans" in rows.columns and table != "anomalies":
            assert rows.filter("spans IS NULL OR size(spans) <> 1 OR spans[0].line_start IS NULL OR spans[0].col_end IS NULL OR spans[0].path <> path OR blob_sha256 = ''").count() == 0
    assert kept.read("run_info").first().git_tree_sha == "t" and {r.path for r in kept.read("files").collect()} == {"a.py", "k.ts", "empty.py", "open.py"}


def test_spans_are_those_of_the_text(kept):
    lines = [line.encode() for line in PY.split("\n")]
    raw = PY.encode()
    seen = set()
    for table in ("nodes", "edges", "symbols", "cfg_blocks", "cfg_edges", "dfg_facts", "effects"):
        for r in kept.read(table).filter("path = 'a.py'").collect():
            s = r.spans[0]
            for at, line, col in ((s.byte_start, s.line_start, s.col_start), (s.byte_end, s.line_end, s.col_end)):
                assert sum(len(x) + 1 for x in lines[:line]) + col == at and col <= len(lines[line])
            seen.add((table, raw[s.byte_start : s.byte_end].decode()))
    assert {("nodes", "'https://hé'"), ("cfg_blocks", "if"), ("dfg_facts", "base_url = 'https://hé'; x = 1"), ("effects", 'session.execute("SELECT * FROM t")')} <= seen


def test_previews_are_redacted_with_their_hashes(kept):
    previews = [dict(r.extra) for r in kept.read("nodes").filter("path = 'a.py' AND semantic_type IN ('Call', 'Literal')").collect()]
    assert all(hashlib.sha256(p["preview"].encode()).hexdigest() == p["preview_sha256"] for p in previews)
    assert any("***07ff" in p["preview"] or '***7ff"' in p["preview"] for p in previews) and not any("24be64439e3e" in p["preview"] for p in previews)
    assert not any("24be64439e3e" in str(r) for t in ("nodes", "effects", "dfg_facts") for r in kept.read(t).collect())


def test_anomalies_metrics_report_and_sarif(kept):
    got = {(r.path, r.anomaly_type, r.severity) for r in kept.read("anomalies").collect()}
    assert got == {("vendor/v.py", "VENDORED_CODE", "INFO"), (None, "PARSE_ERROR", "WARN")} | {("open.py", "PARTIAL_PARSE", "WARN")}
    metrics = {r.path: r for r in kept.read("metrics").collect()}
    assert metrics["a.py"].effect_count == 2 and metrics["a.py"].node_count > 10 and metrics["empty.py"].node_count == 1
    row = analyse.run_report({t: kept.read(t) for t in store.TABLES}, "repo", "one").first()
    assert (row.files, row.languages, row.node_count) == (4, ["python", "typescript"], sum(m.node_count for m in metrics.values()))
    doc = json.loads("".join(r.value for r in report.sarif_parts(report.sarif_results(kept.read("anomalies"), ["WARN", "ERROR"])).orderBy("nth").collect()))
    assert {r["ruleId"] for r in doc["runs"][0]["results"]} == {"UCG.PARSE_ERROR", "UCG.PARTIAL_PARSE"}


def test_lookups_and_orders(kept):
    folder = next(iter(kept.manifest()["nodes"].values()))
    rows = kept.spark.read.parquet(f"{kept.folder}/{folder}").select("language", "semantic_type", "qualified_name", "node_id").collect()
    assert rows == sorted(rows)
    ordered = [r.node_id for r in store.in_order(kept.read("nodes"), "nodes").collect()]
    assert ordered == [r.node_id for r in sorted(kept.read("nodes").collect(), key=lambda r: (r.language, r.semantic_type, r.qualified_name, r.node_id))]


# ------------------------------------------------------------------ as-of join


def test_places_meet_the_lines_before_them(spark):
    r = random.Random(3)
    text = "".join(r.choice(["x" * r.randint(0, 90), ""]) + "\n" for _ in range(200)) + "end"
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    lines = [("f", n, a, (starts[n + 1] - 1 if n + 1 < len(starts) else len(text))) for n, a in enumerate(starts)]
    spans = {(a := r.randrange(len(text) + 1), r.randrange(a, len(text) + 1)) for _ in range(300)} | {(0, 0), (len(text), len(text))}
    table = spark.createDataFrame(lines, "path string, line_no int, byte_start long, byte_end long")
    asked = spark.createDataFrame([("f", a, b) for a, b in spans], "path string, start long, end long")
    for bins in (64, 1 << 16):
        got = {(x.start, x.end): (x.line_start, x.col_start, x.line_end, x.col_end) for x in analyse.located(asked, table, bins).collect()}

        def place(at):
            n = text.count("\n", 0, at)
            return n, at - starts[n]

        assert got == {(a, b): (*place(a), *place(b)) for a, b in spans}


# ---------------------------------------------------------------- replacement


def test_a_file_without_results_loses_its_old_ones(spark, rules, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    for text in ("session.execute('SELECT 1 FROM t')\ndef f(): return 1\n", "x = 1\n"):
        made = analyse.analyse(files(spark, [("a.py", text), ("b.py", "session.execute('SELECT 2 FROM t')\n")][: 2 if "def" in text else 1]), rules, "r", "1")
        s.put_all(made.tables, files=made.files)
    assert {r.path for r in s.read("effects").collect()} == {"b.py"}
    assert {r.path for r in s.read("nodes").collect()} == {"a.py", "b.py"} and s.read("cfg_blocks").count() == 0
    s.put_all({}, files=spark.createDataFrame([("r", "1", "b.py")], "repo_id string, run_id string, path string"))
    assert s.read("effects").count() == 0 and {r.path for r in s.read("files").collect()} == {"a.py"}
    with pytest.raises(ValueError, match="aren't listed"):
        s.put_all({"effects": spark.createDataFrame([("r", "1", "zz", "e")], "repo_id string, run_id string, path string, effect_id string")}, files=spark.createDataFrame([("r", "1", "a.py")], "repo_id string, run_id string, path string"))


def test_a_stream_killed_between_the_commits_changes_nothing_twice(spark, tmp_path):
    source, s = str(tmp_path / "in"), store.Store(spark, f"file://{tmp_path}/store")
    schema = "repo_id string, run_id string, path string, blob_sha256 string"
    runs = []

    class Killed(store.Store):
        def put_all(self, *a, **b):
            super().put_all(*a, **b)
            raise RuntimeError("killed after the store's commit")

    def tables(b):
        runs.append(1)
        return {"files": b.withColumn("rel_path", F.col("path")), "anomalies": b.select("repo_id", "run_id", "path", F.lit("X").alias("anomaly_type"), F.lit("WARN").alias("severity"))}

    def run(into):
        incremental.follow(spark.readStream.schema(schema).parquet(source), into, tables, str(tmp_path / "ck")).awaitTermination(120)

    spark.createDataFrame([("r", "1", "a", "s1"), ("r", "1", "b", "s2")], schema).write.parquet(source)
    with pytest.raises(Exception, match="killed"):
        run(Killed(spark, s.folder))
    run(s)
    assert Counter(r.path for r in s.read("anomalies").collect()) == {"a": 1, "b": 1} and s.read("files").count() == 2 and len(runs) == 1
    spark.createDataFrame([("r", "1", "a", "s3")], schema).write.mode("append").parquet(source)
    run(s)
    assert Counter(r.path for r in s.read("anomalies").collect()) == {"a": 2, "b": 1}


def test_known_files_are_not_analysed_again(spark, tmp_path):
    source, s = str(tmp_path / "in"), store.Store(spark, f"file://{tmp_path}/store")
    schema = "repo_id string, run_id string, path string, blob_sha256 string"
    analysed = []

    def tables(b):
        analysed.extend((r.path, r.blob_sha256) for r in b.collect())
        return {"files": b.withColumn("rel_path", F.col("path")), "metrics": b.withColumns({"cache_state": F.lit("miss"), "node_count": F.lit(5), "ts": F.current_timestamp()})}

    def run(rows, fingerprint=None, **options):
        analysed.clear()
        spark.createDataFrame([("r", "1", *r) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
        incremental.follow_cached(spark.readStream.schema(schema).parquet(source), s, tables, str(tmp_path / "ck"), fingerprint, **options).awaitTermination(40)
        return sorted(analysed)

    both = [("a", "s1"), ("b", "s2")]
    assert run(both) == both
    assert run(both) == [] and {(r.path, r.cache_state, r.node_count) for r in s.read("metrics").collect()} == {("a", "hit", 5), ("b", "hit", 5)}
    assert s.read("files").count() == 2
    assert run([("a", "s3"), ("b", "s2")]) == [("a", "s3")]
    assert {(r.path, r.blob_sha256, r.cache_state) for r in s.read("metrics").collect()} == {("a", "s1", "hit"), ("a", "s3", "miss"), ("b", "s2", "hit")}
    assert run([("a", "s3"), ("b", "s2")], "other patterns") == [("a", "s3"), ("b", "s2")]


def test_packs_changed_between_batches_hold_from_the_next_one(spark, tmp_path):
    import os

    packs, source = tmp_path / "packs", str(tmp_path / "in")
    packs.mkdir()

    def pack(callee, at):
        rule = {"id": "r", "effect_kind": "cache", "provider": "x", "patterns": [{"kind": "call", "callee": callee}]}
        (packs / "p.json").write_text(json.dumps({"name": "p", "rules": [rule]}))
        os.utime(packs / "p.json", (at, at))

    s, registry = store.Store(spark, f"file://{tmp_path}/store"), rule_packs.Registry()
    schema = "path string, text string"
    for n, callee in enumerate(("one", "two")):
        pack(callee, 1e9 + n)
        spark.createDataFrame([(f"{n}.py", "one(1)\ntwo(2)\n")], schema).write.mode("append").parquet(source)
        rows = spark.readStream.schema(schema).parquet(source)
        incremental.follow(rows, s, incremental.analysing(registry, packs, "r", "1"), str(tmp_path / "ck")).awaitTermination(180)
    assert {(r.path, r.spans[0].line_start) for r in s.read("effects").collect()} == {("0.py", 0), ("1.py", 1)}
    assert registry.refresh(packs) == []


# --------------------------------------------------------------------- status


def test_statuses_of_real_texts(spark):
    rows = [("ok.py", "x = 1\n", 6, False), ("bin.py", None, 10, False), ("lost.py", None, 10, True), ("big.py", None, 60 << 20, False), ("min.js", "a," * 6000, 11 << 20, False), ("wide.py", "x = 1\n", 11 << 20, False)]
    decided = discovery.decide(spark.createDataFrame(rows, "rel_path string, text string, size long, read_error boolean"), discovery.Options(max_bytes=1 << 30, include_minified=True))
    got = analyse.statuses(decided)
    assert {r.rel_path: r.status for r in got.collect()} == {"ok.py": "OK", "bin.py": "BINARY", "lost.py": "ERROR", "big.py": "TOO_LARGE", "min.js": "PATHOLOGICAL", "wide.py": "OK"}
    assert {(r.path, r.anomaly_type, r.reason_detail) for r in analyse.status_anomalies(got).collect()} == {("lost.py", "READ_ERROR", "file can't be read"), ("big.py", "FILE_TOO_LARGE", "60.0MB > 50MB"), ("min.js", "PATHOLOGICAL_FILE", "minified")}


def test_sizes_and_errors_of_the_forest(spark):
    text = "x = f(a, [1, 2])\nif x:\n    g('s')\n"
    broken = "f((((\n" * 3 + "]\n" + "(]\n"
    rows = captures.lines(spark.createDataFrame([("a.py", "python", text), ("b.py", "python", broken), ("c.py", "python", "")], "path string, language string, text string"))
    found = captures.tokens(rows)
    pairs = captures.brackets(found)
    got = {r.path: (r.nodes, r.errors) for r in captures.forest(rows, found, pairs).collect()}
    assert got["a.py"] == (1 + 3 + 3 + 4, 0) and got["c.py"] == (1, 0)  # a file, statements, pairs, f if g 's'
    assert got["b.py"][1] == 15
    by = {r.open: (r.left, r.right) for r in pairs.filter("path = 'a.py'").collect()}
    assert sorted(by.values()) == [(1, 4), (2, 3), (5, 6)]
    many = spark.createDataFrame([("m", 60_000, 5_000), ("n", 60_000, 4_999), ("o", 50_000, 50_000)], "path string, nodes long, errors long")
    assert [(r.path, r.reason_detail) for r in analyse.partial_anomalies(many).collect()] == [("m", "error_density≈10% on sample")]
