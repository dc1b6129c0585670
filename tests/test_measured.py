"""Queries of code take the sizes of joins from measured data, and as many tasks as there are cores."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from sourceloom import code_queries, queries, session, store_queries
from sourceloom.operators import graph, intervals
from sourceloom.plans import store
from sourceloom.plans.staging import stage_table
from sourceloom.session import measured_session
from sourceloom.sources import captures


def _first_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_tables_that_compress_well_are_not_broadcast_by_their_files(spark):
    own = measured_session(spark)
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")

    def joined(session):
        rows = stage_table(session.range(60_000, numPartitions=1).select("id", F.repeat(F.lit("x"), F.lit(500)).alias("text")), "rows")  # 30 MB in some 100 KB of file
        return rows.join(rows.withColumnRenamed("text", "other"), "id")

    assert "BroadcastHashJoin" in _first_plan(joined(spark)) and "BroadcastHashJoin" not in _first_plan(joined(own))
    assert joined(own).count() == 60_000
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "256k"


@pytest.mark.parametrize("made", [code_queries.source_files, code_queries.hard_files, code_queries.encodings_told])
def test_files_are_made_by_many_tasks(spark, sf, made):
    assert made(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_graph_is_built_in_a_measured_session(spark, sf):
    built = code_queries.built(spark, sf)
    for df in (built.nodes, built.edges, built.bindings, built.metrics, built.anomalies):
        assert df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"


def test_strings_are_found_without_the_other_tokens(spark, sf):
    for files in (code_queries.source_files(spark, sf), code_queries.hard_files(spark, sf)):
        rows = stage_table(captures.lines(files), "lines")
        alone, among = (captures.literals(rows, found) for found in (None, captures.tokens(rows)))
        assert alone.count() > 0 and alone.exceptAll(among).count() == among.exceptAll(alone).count() == 0
        plan = captures.tokens(rows, captures._MARKS)._jdf.queryExecution().optimizedPlan().toString()
        assert "class|function" not in plan


def test_signs_that_part_tokens_may_stand_in_a_text(spark):
    text = "f(1)\n\x07 = g(\x07)\ns = '\x07' + h('a')\x07\n"
    rows = stage_table(captures.lines(spark.createDataFrame([("a.py", "python", text)], "path string, language string, text string")), "lines")
    found = captures.tokens(rows).orderBy("start").collect()
    assert [t.token for t in found if t.token[0].isalpha()] == ["f", "g", "h"]
    assert all(text[t.start : t.start + len(t.token)] == t.token for t in found if ord(t.token[0]) > 31)
    assert [x.text for x in captures.literals(rows).orderBy("start").collect()] == ["'\x07'", "'a'"]


def test_lines_are_cut_once(spark, sf):
    rows = stage_table(captures.lines(code_queries.source_files(spark, sf)), "lines")
    plan = captures.tokens(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(translate(") == 1


def test_tables_of_the_graph_read_captures_and_do_not_make_them_again(spark, sf):
    built = code_queries.built(spark, sf)
    for df in (built.anomalies, built.metrics, built.edges):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 6


@pytest.mark.parametrize("rows, least", [(2000, 1), (10, 20)])
def test_partitions_grow_with_the_rows(spark, sf, monkeypatch, rows, least):
    monkeypatch.setattr(session, "PARTITION_ROWS", rows)
    files = code_queries.source_files(spark, sf)
    assert spark.read.parquet(f"{sf}/part.parquet").count() == 200
    assert files.rdd.getNumPartitions() == max(least, 4 * spark.sparkContext.defaultParallelism)
    lines = stage_table(captures.lines(files), "lines")
    assert captures.tokens(lines).rdd.getNumPartitions() == files.rdd.getNumPartitions()  # tokens of one file of lines are made by many tasks


def test_sizes_of_settings():
    assert [session._bytes(x) for x in ("16m", "134217728b", "128MB", "8388608", "1 GiB")] == [16 << 20, 128 << 20, 128 << 20, 8 << 20, 1 << 30]


def test_plans_of_the_graph_are_not_compiled_by_the_driver(spark, sf):
    built = code_queries.built(spark, sf)
    for df in (built.nodes, built.frames, built.metrics, built.facts):
        assert "*(1)" not in df._jdf.queryExecution().executedPlan().toString().replace(" ", "") and int(df.sparkSession.conf.get("spark.sql.maxPlanStringLength")) <= 10_000
        df.count()
        assert "WholeStageCodegen" not in df._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.codegen.wholeStage") == "true"


def test_store_keeps_nothing_in_memory(spark, tmp_path, monkeypatch):
    def persist(*_):
        raise AssertionError("partitions of a kept table aren't put together")

    monkeypatch.setattr(type(spark.range(1)), "persist", persist)
    kept = store.Store(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("r", "1", "a.py"), ("r", "1", "b.py")], "repo_id string, run_id string, path string")
    odd = files.select("*", F.lit("T").alias("anomaly_type"))
    for batch, looked in enumerate((files, files.filter("path = 'a.py'"))):
        assert kept.put_all({"files": looked, "anomalies": odd.join(looked, ["repo_id", "run_id", "path"])}, files=looked, batch=("s", batch))
    assert [r.path for r in kept.read("files").orderBy("path").collect()] == ["a.py", "b.py"]
    assert [r.path for r in kept.read("anomalies").orderBy("path").collect()] == ["a.py", "a.py", "b.py"]


_DEFS = {"lines", "tokens", "brackets", "members", "head-spans", "defs", "definitions", "modules"}
_CALLED = _DEFS | {"functions", "call-spans", "calls"}
_MADE = {
    "graph_frames": _DEFS,
    "graph_nodes": _CALLED - {"functions"} | {"import-spans", "import-lines", "imports", "exports", "literal-spans", "literals"},
    "flow_metrics": _CALLED | {"flow-tokens", "written", "facts"},
    "detect_metrics": _CALLED | {"owned-calls", "matched"},
}


@pytest.mark.parametrize("name", _MADE)
def test_a_query_makes_only_the_tables_that_it_reads(spark, sf, monkeypatch, name):
    monkeypatch.setattr(code_queries, "_built", {})
    rows = queries.QUERIES[name](spark, sf)
    (built,) = code_queries._built.values()
    stages = [x._stage_path.rsplit("/", 1)[1].rpartition("-")[0] for x in built.stages]
    assert {*stages} == _MADE[name] and len(stages) == len(_MADE[name])
    assert rows.count() == {"graph_frames": 700, "graph_nodes": 2300}.get(name, 200)


def test_metrics_that_are_asked_for_are_those_of_all(spark, sf):
    built = code_queries.built(spark, sf)
    names = ("facts", "errors", "calls", "pack_errors")
    some, whole = built.metrics_of(*names), built.metrics.select("path", *names)
    assert some.schema == whole.schema and some.exceptAll(whole).count() == whole.exceptAll(some).count() == 0


_FILE = "'r' repo_id", "'1' run_id", "concat('f', id) path"


def test_store_is_written_in_rounds_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store.Store, "ROUND_FILES", 10)
    kept = store.Store(spark, str(tmp_path / "store"))
    files = spark.range(40).selectExpr(*_FILE)
    own, shared = files.withColumns({"node_id": F.concat(F.lit("n"), "path"), "symbol_id": F.concat(F.lit("s"), "path")}), files.withColumn("symbol_id", F.lit("s"))
    tables = {"files": files, "nodes": own.union(own), "symbols": own.drop("node_id").union(shared)}

    def folders(table):
        return {f.rsplit("/", 1)[0] for f in kept.manifest()[table].values()}

    kept.put_all(tables, files=files)
    assert [len(folders(t)) for t in ("files", "nodes", "symbols")] == [4, 4, 4]
    assert [kept.read(t).count() for t in ("files", "nodes", "symbols")] == [40, 40, 41]  # a key of several files once
    some = files.filter("path = 'f7'")
    kept.put_all({"nodes": own.join(some, ["repo_id", "run_id", "path"]).withColumn("name", F.lit("new"))}, files=some)
    assert kept.read("nodes").count() == 40 and kept.read("nodes").filter("name = 'new'").count() == 1 and kept.read("files").count() == 39
    with pytest.raises(ValueError, match="aren't listed"):
        kept.put_all({"effects": spark.range(100, 200).selectExpr(*_FILE, "'e' effect_id")}, files=files)


def test_store_leaves_no_shuffle_files(spark, tmp_path):
    def left():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x.rsplit("/", 1)[-1] for x in held.mkString("\n").split("\n") if "/shuffle_" in x}

    kept, files = store.Store(spark, str(tmp_path / "store")), spark.range(40).selectExpr(*_FILE)
    before = left()
    kept.put_all({"files": files, "nodes": files.withColumn("node_id", F.col("path"))}, files=files)
    until = time.time() + 10
    while left() - before and time.time() < until:
        time.sleep(0.2)
    assert not left() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false" and spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    (one,) = list((tmp_path / "store").glob("files/*/_bucket=*/*.parquet"))[:1]
    assert one.stat().st_size < 200_000  # its Bloom filters are as large as its values ask for


def test_old_versions_of_stored_queries_are_deleted(spark, sf):
    kept = store_queries.stored(spark, sf)
    for table, buckets in kept.manifest().items():
        assert set(kept._list(f"{kept.folder}/{table}")) == {f.split("/")[1] for f in buckets.values()}
    assert len(kept._list(f"{kept.folder}/manifests")) == 1


def test_scopes_come_from_one_join(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(intervals, "containing", lambda *a, real=intervals.containing, **k: made.append(1) or real(*a, **k))
    files = code_queries.source_files(spark, sf).filter("path LIKE 'src/p1%'")
    defs = graph.Graph(files, None).definitions
    assert len(made) == 1
    bare = defs.select("path", "start", "end", "def_key", "name")
    parts = intervals.chains(bare, ["path"], "def_key", F.col("name")).join(intervals.parents(bare.drop("name"), ["path"], "def_key"), "def_key")
    whole = intervals.nested(bare, ["path"], "def_key", F.col("name"), bins=16).select(parts.columns)
    assert {*map(tuple, whole.collect())} == {*map(tuple, parts.collect())} and defs.filter("semantic_type = 'Method'").count() > 0


def test_members_pass_over_the_brackets_once(spark, sf):
    rows = stage_table(captures.lines(code_queries.hard_files(spark, sf).limit(9)), "lines")
    found = stage_table(captures.tokens(rows), "tokens")
    pairs = stage_table(captures.brackets(found), "brackets")
    plan = captures.members(found, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Window [") == 4  # depths, what comes before and after, what is around


def test_names_above_are_kept_for_lines_that_hang_on_them(spark):
    text = "a.b\n  .c(1)\nd = e\n"
    rows = captures.lines(spark.createDataFrame([("a.js", "javascript", text)], "path string, language string, text string")).orderBy("line_no").collect()
    assert [r.above and (r.above.at, r.above.line_no, r.above.chain) for r in rows[:4]] == [None, (3, 0, "a.b"), (11, 1, None), (17, 2, None)]


def test_only_tables_of_measured_sessions_are_zstd(spark):
    for own, ending in ((measured_session(spark), ".zstd.parquet"), (spark, ".snappy.parquet")):
        assert all(x.endswith(ending) for x in stage_table(own.range(9), "codec").inputFiles())
