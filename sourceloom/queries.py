"""Registered queries over the driver's tables, and their DuckDB SQL.

The tables hold no source code; so each operator runs over a derived view of
them: documents as the blobs of a virtual repository, events as spans and
tokens of users, page urls as routes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from sourceloom.functions import fixed, ids
from sourceloom.functions import text as T
from sourceloom.operators import discovery, effects, flow, graph, intervals
from sourceloom.plans import report, store
from sourceloom.session import measured_session, ship_package
from sourceloom.sources import captures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ discovery

OPTIONS = discovery.Options(deny=(*fixed.DENY_GLOBS, "lib/source/f?3.*"), allow=("*/f*",), max_bytes=20_000)

_VF = """
vf AS (
  SELECT doc_id, text,
    CASE doc_id % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'lib' WHEN 2 THEN 'vendor' WHEN 3 THEN 'a/node_modules' ELSE 'gen' END || '/source/f' || doc_id ||
    CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.jsx' WHEN 3 THEN '.ts' WHEN 4 THEN '.TSX' WHEN 5 THEN '.min.js' ELSE '.md' END AS rel_path
  FROM documents)
"""
_DECIDED = (
    _VF
    + r""",
fl AS (
  SELECT *, lower(regexp_extract(rel_path, '(\.[^./]*)$', 1)) AS ext, octet_length(encode(text))::BIGINT AS size_bytes,
    list_has_any(string_split(rel_path, '/'), ['node_modules','vendor','third_party','.venv','site-packages','dist','build','.next','.cache','.turbo','.parcel-cache']) AS vendor,
    regexp_matches(lower(text[1:16384]), '@generated|@auto-generated|autogenerated|codegen|do not edit') AS generated
  FROM vf),
fm AS (
  SELECT *, CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' END AS language,
    ext IN ('.js', '.jsx') AND (regexp_matches(lower(rel_path), '(\.min\.js|\.bundle\.js|\.min\.jsx)$')
      OR octet_length(encode(text[1:200000])) / greatest(len(string_split(text[1:200000], chr(10))) - 1, 1) > 240) AS minified
  FROM fl),
dec AS (
  SELECT *, CASE
    WHEN regexp_matches(rel_path, '(?s)^(.*/\.git/.*|.*/\.hg/.*|.*/\.svn/.*|.*/.*\.lock|lib/source/f.3\..*)$') THEN 'skipped_deny_glob'
    WHEN NOT regexp_matches(rel_path, '(?s)^.*/f.*$') THEN 'skipped_not_allowed'
    WHEN language IS NULL THEN 'skipped_unsupported'
    WHEN size_bytes > 20000 THEN 'oversize'
    WHEN vendor THEN 'skipped_vendor' WHEN minified THEN 'skipped_minified' WHEN generated THEN 'skipped_generated'
    ELSE 'supported' END AS decision
  FROM fm)
"""
)


def virtual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(column, values):
        out = F.lit(values[-1])
        for k, v in reversed(list(enumerate(values[:-1]))):
            out = F.when(column == k, v).otherwise(out)
        return out

    folder = pick(F.col("doc_id") % 5, ["src", "lib", "vendor", "a/node_modules", "gen"])
    suffix = pick(F.col("doc_id") % 7, [".py", ".js", ".jsx", ".ts", ".TSX", ".min.js", ".md"])
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(folder, F.lit("/source/f"), F.col("doc_id").cast("string"), suffix).alias("rel_path"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.decide(virtual_files(spark, sf_dir), OPTIONS)


@query(f"WITH {_DECIDED} SELECT rel_path, language, size_bytes, vendor, minified, generated, decision FROM dec")
def discovery_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("rel_path", "language", "size_bytes", "flags.*", "decision")


@query(
    f"WITH {_DECIDED} SELECT count(*) AS files_seen, "
    + ", ".join(f"count(*) FILTER (decision = '{t}') AS {t}" for t in discovery.TALLIES)
    + ", 0::BIGINT AS symlink_traversed, count(*) FILTER (decision = 'supported') AS parse_candidates FROM dec"
)
def discovery_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.tallies(decided(spark, sf_dir))


@query(f"WITH {_DECIDED} SELECT rel_path, language, size_bytes, sha256(text) AS blob_sha256 FROM dec WHERE decision = 'supported' ORDER BY rel_path, blob_sha256")
def discovery_files_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = decided(spark, sf_dir).filter(F.col("decision") == "supported")
    return kept.select("rel_path", "language", "size_bytes", F.sha2("text", 256).alias("blob_sha256")).orderBy("rel_path", "blob_sha256")


@query(
    f"""WITH {_DECIDED} SELECT rel_path AS path, t AS anomaly_type, s AS severity, decision AS reason_detail FROM dec, (VALUES
  ('oversize', 'OVERSIZE_FILE', 'ERROR'), ('skipped_vendor', 'VENDORED_CODE', 'INFO'), ('skipped_minified', 'MINIFIED_JS', 'INFO'), ('skipped_generated', 'GENERATED_CODE', 'INFO')) v(d, t, s)
  WHERE decision = d"""
)
def discovery_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.anomalies(decided(spark, sf_dir))


@query("SELECT doc_id, sha256(text) AS blob_sha256, octet_length(encode(text))::BIGINT AS size_bytes FROM documents")
def blob_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("blob_sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


# ------------------------------------------------------------------------ ids


def _sql_id(*parts: str) -> str:
    return "substr(sha256(" + " || ".join(f"{p} || chr(0)" for p in parts) + "), 1, 24)"


@query(
    f"WITH {_VF}, s AS (SELECT *, rel_path || ':' || doc_id || '-' || (doc_id + 10) AS span FROM vf) SELECT doc_id, "
    f"{_sql_id(chr(39) + 'node' + chr(39), chr(39) + 'Function' + chr(39), chr(39) + 'python' + chr(39), 'rel_path', 'span')} AS node_id, "
    f"{_sql_id(chr(39) + 'sym' + chr(39), chr(39) + 'python' + chr(39), 'rel_path', chr(39) + 'function' + chr(39), chr(39) + 'f(2)||' + chr(39))} AS symbol_id, "
    f"{_sql_id(chr(39) + 'edge' + chr(39), chr(39) + 'calls' + chr(39), 'rel_path', 'span', 'span')} AS edge_id FROM s"
)
def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, start = F.col("rel_path"), F.col("doc_id")
    span = ids.span_key(path, start, start + 10)
    python = F.lit("python")
    return virtual_files(spark, sf_dir).select(
        "doc_id", ids.node_id("Function", python, path, span).alias("node_id"), ids.symbol_id(python, path, "function", F.lit("f(2)||")).alias("symbol_id"),
        ids.edge_id("calls", path, span, span).alias("edge_id"),
    )


@query(f"WITH {_VF} SELECT doc_id, substr(sha256(rel_path || chr(0) || doc_id || chr(0) || (doc_id + 7) || chr(0) || 'group'), 1, 24) AS receipt_id FROM vf")
def receipt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_files(spark, sf_dir).select("doc_id", ids.receipt_id(F.col("rel_path"), F.col("doc_id"), F.col("doc_id") + 7, "group").alias("receipt_id"))


# ------------------------------------------------------------------ redaction


def _sql_mask(source: str, patterns: tuple[str, ...], first: str) -> str:
    """CTEs m0, m1, ... that mask one pattern after the other; the last one is named after their number."""
    out = [f"m0 AS (SELECT doc_id, text, {first} AS t FROM {source})"]
    for k, pattern in enumerate(patterns):
        p = pattern.replace("'", "''")
        mask = "CASE WHEN length(q) <= 8 THEN '***' ELSE '***' || right(q, 4) END"
        out.append(
            f"m{k + 1} AS (SELECT doc_id, text, array_to_string(list_transform(regexp_split_to_array(t, '{p}'), lambda x, i: x || coalesce(list_transform(regexp_extract_all(t, '{p}'), lambda q: {mask})[i], '')), '') AS t FROM m{k})"
        )
    return ", ".join(out)


@query(
    f"WITH {_sql_mask('documents', fixed.STORE_PATTERNS, 'text')}, c AS (SELECT doc_id, CASE WHEN length(t) > 200 THEN t[1:200] || '…' ELSE t END AS preview FROM m4) "
    "SELECT doc_id, preview, sha256(preview) AS preview_sha256 FROM c"
)
def redact_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.redact_store(F.col("text")).alias("preview"))
    return rows.withColumn("preview_sha256", F.sha2("preview", 256))


@query(f"WITH {_sql_mask('documents', fixed.EFFECT_PATTERNS, 'text[1:200]')} SELECT doc_id, t AS preview FROM m4")
def redact_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact_effect(F.col("text")).alias("preview"))


@query(
    f"WITH {_sql_mask('documents', fixed.CAPTURE_PATTERNS, 'CASE WHEN length(text) > (CASE WHEN octet_length(encode(text)) > 1000000 THEN 100 ELSE 200 END) THEN text[1:(CASE WHEN octet_length(encode(text)) > 1000000 THEN 100 ELSE 200 END)] || ' + chr(39) + '…' + chr(39) + ' ELSE text END')} SELECT doc_id, t AS preview FROM m2"
)
def redact_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact_capture(F.col("text"), F.octet_length("text")).alias("preview"))


@query(
    r"""
SELECT doc_id, concat_ws(',',
  CASE WHEN list_bool_or(list_transform(string_split(text, chr(10))[1:200], lambda x: length(x) >= 2000))
    OR (length(text) >= 1000 AND len(regexp_extract_all(text, '[ \t\n\r\f\v]')) / length(text) < 0.05) THEN 'minified' END,
  CASE WHEN text[1:20000] LIKE '%[%' AND len(regexp_extract_all(text[1:20000], ',')) > 5000 THEN 'array' END) AS signs
FROM documents"""
)
def pathological_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.pathological(F.col("text")).alias("signs"))


# -------------------------------------------------------------- normalisation

_ROUTE = "regexp_replace(url, '^https?:/', '') || CASE page_id % 6 WHEN 0 THEN '/{id}/' WHEN 1 THEN '/[...slug]' WHEN 2 THEN '/$' || '{id}' WHEN 3 THEN '/:id<int>' WHEN 4 THEN '//a//b' ELSE '/' END"


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.lit("/")
    for k, v in ((4, "//a//b"), (3, "/:id<int>"), (2, "/${id}"), (1, "/[...slug]"), (0, "/{id}/")):
        tail = F.when(F.col("page_id") % 6 == k, F.lit(v)).otherwise(tail)
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.regexp_replace("url", "^https?:/", ""), tail).alias("route"))


@query(
    rf"""
WITH r AS (SELECT page_id, {_ROUTE} AS route FROM pages),
a AS (SELECT *, regexp_replace(trim(route), '^["'']+|["'']+$', '', 'g') AS t FROM r),
b AS (SELECT *, regexp_replace(t, '\[(\.\.\.)?([A-Za-z0-9_]+)\??\]', ':\2', 'g') AS u FROM a),
c AS (SELECT *, regexp_replace(u, '\$\{{([A-Za-z0-9_]+)\}}', ':\1', 'g') AS v FROM b),
d AS (SELECT *, regexp_replace(v, '\{{([A-Za-z0-9_]+)\}}', ':\1', 'g') AS w FROM c),
e AS (SELECT *, regexp_replace(w, ':([A-Za-z0-9_]+)<[^>]+>', ':\1', 'g') AS x FROM d),
f AS (SELECT *, regexp_replace(regexp_replace(x, '//+', '/', 'g'), '(.)/$', '\1') AS y FROM e)
SELECT page_id, CASE WHEN route = '' THEN route WHEN y = '' THEN '/' ELSE y END AS path FROM f"""
)
def http_path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(spark, sf_dir).select("page_id", T.http_path(F.col("route")).alias("path"))


@query(r"SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '\d{3}', 0), '') AS INTEGER) AS status FROM pages")
def http_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.http_status(F.col("url")).alias("status"))


_CALLEE = "CASE page_id % 5 WHEN 0 THEN 'app.get' WHEN 1 THEN 'router.Post' WHEN 2 THEN 'fetch' WHEN 3 THEN 'client.delete' ELSE 'target' END"


@query(f"SELECT page_id, upper(nullif(regexp_extract(lower({_CALLEE}), '\\b(get|post|put|patch|delete|head|options)\\b', 1), '')) AS method FROM pages")
def method_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.default_method(F.expr(_CALLEE)).alias("method"))


_SQL_TEXT = (
    "CASE o_orderkey % 6 WHEN 0 THEN '  select * from t' || o_custkey || ' where a = 1' WHEN 1 THEN 'INSERT INTO \"s.o' || o_custkey || '\" VALUES (1)' "
    "WHEN 2 THEN 'Update u_' || o_custkey || ' set x = 2' WHEN 3 THEN 'DELETE FROM d.' || o_custkey WHEN 4 THEN 'TRUNCATE t' ELSE 'EXPLAIN SELECT 1 FROM q' END"
)


@query(
    rf"""
WITH s AS (SELECT o_orderkey, regexp_replace(trim({_SQL_TEXT}), '^[`"]+|[`"]+$', '', 'g') AS s FROM orders),
o AS (SELECT *, upper(regexp_extract(s, '(?i)^\s*(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE)\b', 1)) AS op FROM s)
SELECT o_orderkey, op, nullif(regexp_replace(CASE WHEN op = 'SELECT' THEN regexp_extract(s, '(?i)\bFROM\s+([A-Za-z0-9_."]+)', 1)
  WHEN op IN ('INSERT', 'UPDATE', 'DELETE') THEN regexp_extract(s, '(?i)\b(?:INTO|UPDATE|FROM)\s+([A-Za-z0-9_."]+)', 1) ELSE '' END, '^"+|"+$', '', 'g'), '') AS table_name
FROM o"""
)
def sql_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr(_SQL_TEXT)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.sql_operation(s).alias("op"), T.sql_table(s).alias("table_name"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(trim('"' || url || '//x"'), '^["'']+|["'']+$', '', 'g'), '//+', '/', 'g') AS topic FROM pages""")
def topic_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.topic(F.concat(F.lit('"'), "url", F.lit('//x"'))).alias("topic"))


_IMPORT = (
    "CASE p_partkey % 4 WHEN 0 THEN 'from pkg.m' || p_size || ' import a' || p_partkey || ' as b, c' WHEN 1 THEN 'import os' || p_size || ', sys as s' "
    "WHEN 2 THEN 'from m' || p_size || ' import *' ELSE 'from x import (' || chr(10) || '  y' || p_partkey || ',' || chr(10) || '  z as w,' || chr(10) || ')' END"
)


@query(
    r"""
WITH i AS (SELECT p_partkey, p_partkey % 4 AS k, p_size FROM part)
SELECT p_partkey, 'pkg.m' || p_size AS module, 'a' || p_partkey AS imported, 'b' AS alias, 'named' AS kind FROM i WHERE k = 0
UNION ALL SELECT p_partkey, 'pkg.m' || p_size, 'c', 'c', 'named' FROM i WHERE k = 0
UNION ALL SELECT p_partkey, 'os' || p_size, NULL, 'os' || p_size, 'module' FROM i WHERE k = 1
UNION ALL SELECT p_partkey, 'sys', NULL, 's', 'module' FROM i WHERE k = 1
UNION ALL SELECT p_partkey, 'm' || p_size, '*', '*', 'star' FROM i WHERE k = 2
UNION ALL SELECT p_partkey, 'x', 'y' || p_partkey, 'y' || p_partkey, 'named' FROM i WHERE k = 3
UNION ALL SELECT p_partkey, 'x', 'z', 'w', 'named' FROM i WHERE k = 3"""
)
def py_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(T.python_imports(F.expr(_IMPORT))).alias("b"))
    return rows.select("p_partkey", "b.*")


_ALIASES = (
    "CASE p_partkey % 4 WHEN 0 THEN 'from m import a' || p_partkey || ' as b, c as b, d' || p_size WHEN 1 THEN 'import os' || p_size || '.path, sys as s' "
    "WHEN 2 THEN 'import D, { a as b' || p_size || ', D } from \"m\"' ELSE 'from m' || p_size || ' import *' END"
)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'b,d' || p_size WHEN 1 THEN 'os' || p_size || ',s' WHEN 2 THEN 'D,b' || p_size ELSE '' END AS aliases FROM part")
def import_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.when(F.col("p_partkey") % 4 == 2, "javascript").otherwise("python")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(graph.import_aliases(F.expr(_ALIASES), language), ",").alias("aliases"))


@query(
    r"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '/x' WHEN 1 THEN '{x}/' || event_type WHEN 2 THEN event_type || 'tail' ELSE 'dyn:{x}' END AS value,
  CASE event_id % 4 WHEN 0 THEN 'FOLDED' WHEN 1 THEN 'FOLDED,NON_LITERAL_PART' WHEN 2 THEN 'FOLDED' ELSE 'DYNAMIC' END AS flags
FROM events"""
)
def dfg_fold_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "''''"
    code = F.expr(f"CASE event_id % 4 WHEN 0 THEN concat({q}, event_type, '/x', {q}) WHEN 1 THEN concat('base + ', {q}, '/', event_type, {q}) WHEN 2 THEN concat('\"', event_type, '\" + ', {q}, 'tail', {q}) ELSE 'build()' END".replace("''''", '"\'"'))
    folded = T.fold_concat(code)
    return table(spark, sf_dir, "events").select("event_id", folded["value"].alias("value"), F.array_join(folded["flags"], ",").alias("flags"))


# ------------------------------------------------------------------ intervals


def _micros(column: str = "ts"):
    """Microseconds of a wall-clock time, whatever the session's time zone."""
    return F.unix_micros(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


def event_spans(spark: SparkSession, sf_dir: str, scale: float | None = None) -> DataFrame:
    """Events as spans of their user: six hours, or their value in units of ``scale`` seconds."""
    length = F.lit(6 * 3600 * 1_000_000) if scale is None else F.floor(F.abs(F.coalesce("value", F.lit(0.0))) * scale * 1_000_000)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _micros().alias("start"), length.cast("long").alias("size"))
    return rows.select("event_id", "user_id", "event_type", "start", (F.col("start") + F.col("size")).alias("end"))


_SPANS6 = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + 21600000000 AS t FROM events)"
_ISLANDS = (
    _SPANS6
    + """,
r AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY s, t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, (sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, t, event_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS island FROM r)
"""
)


@query(f"WITH {_ISLANDS} SELECT event_id, user_id, island FROM g")
def group_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(event_spans(spark, sf_dir), ["user_id"], "start", "end", "event_id").select("event_id", "user_id", "island")


@query(f"WITH {_ISLANDS} SELECT user_id, island, min(s) AS start, max(t) AS \"end\", count(*) AS members, arg_min(event_id, (s, t, event_id)) AS first_event_id, arg_max(event_id, (s, t, event_id)) AS last_event_id FROM g GROUP BY user_id, island")
def group_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.island_spans(event_spans(spark, sf_dir), ["user_id"], "start", "end", "event_id")


@query(f"WITH {_ISLANDS} SELECT user_id, island, array_to_string(list_sort(list_distinct(list(event_type))), ';') AS raw_type FROM g GROUP BY user_id, island")
def raw_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = intervals.islands(event_spans(spark, sf_dir), ["user_id"], "start", "end", "event_id")
    return marked.groupBy("user_id", "island").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("raw_type"))


@query(f"WITH {_ISLANDS} SELECT user_id, island, string_agg(event_type, ',' ORDER BY s, t, event_id) AS previews FROM g GROUP BY user_id, island")
def group_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = intervals.islands(event_spans(spark, sf_dir), ["user_id"], "start", "end", "event_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "event_id", "event_type"))), lambda x: x["event_type"])
    return marked.groupBy("user_id", "island").agg(F.array_join(listed, ",").alias("previews"))


_SPANSV = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + floor(abs(coalesce(value, 0.0)) * 600.0 * 1000000)::BIGINT AS t FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, t DESC, event_id) AS ord FROM e)"


@query(f"WITH {_SPANSV} SELECT c.event_id, arg_max(p.event_id, p.ord) AS parent FROM o c LEFT JOIN o p ON c.user_id IS NOT DISTINCT FROM p.user_id AND p.s <= c.s AND p.t >= c.t AND p.ord < c.ord GROUP BY c.event_id")
def containment_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.parents(event_spans(spark, sf_dir, 600.0), ["user_id"], "event_id")


@query(
    f"WITH {_SPANSV}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, t DESC, event_id) AS ford FROM e WHERE event_id % 3 = 0) "
    "SELECT c.event_id, arg_min(f.event_id, (f.t - f.s, f.s, f.ford)) AS owner FROM e c LEFT JOIN f ON c.user_id IS NOT DISTINCT FROM f.user_id AND f.s <= c.s AND f.t >= c.t GROUP BY c.event_id"
)
def nearest_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = event_spans(spark, sf_dir, 600.0)
    outer = intervals.place_in_order(spans.filter(F.col("event_id") % 3 == 0), ["user_id"], "event_id")
    return intervals.smallest_owner(spans, outer, ["user_id"], "event_id", "event_id")


@query(
    f"WITH {_SPANSV}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, t DESC, event_id) AS ford FROM e WHERE event_id % 3 = 0) "
    "SELECT c.event_id, arg_max(f.event_id, (f.s, -f.t, f.ford)) AS owner FROM e c LEFT JOIN f ON c.user_id IS NOT DISTINCT FROM f.user_id AND f.s <= c.s AND f.t >= c.t GROUP BY c.event_id"
)
def effect_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With bins, as one user's spans may be very many."""
    spans = event_spans(spark, sf_dir, 600.0)
    outer = intervals.place_in_order(spans.filter(F.col("event_id") % 3 == 0), ["user_id"], "event_id")
    return intervals.innermost_owner(spans, outer, ["user_id"], "event_id", "event_id", bins=86_400_000_000)


_CHAIN = f"WITH {_SPANSV} SELECT c.event_id, count(p.ord) AS depth, coalesce(string_agg(p.event_type || p.event_id, '::' ORDER BY p.ord) || '::', '') || c.event_type || c.event_id AS chain FROM o c LEFT JOIN o p ON c.user_id IS NOT DISTINCT FROM p.user_id AND p.s <= c.s AND p.t >= c.t AND p.ord < c.ord GROUP BY c.event_id, c.event_type"


@query(_CHAIN)
def qname_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.chains(event_spans(spark, sf_dir, 600.0), ["user_id"], "event_id", F.concat("event_type", F.col("event_id").cast("string")))


@query(f"SELECT event_id, depth FROM ({_CHAIN})")
def scope_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qname_chain(spark, sf_dir).select("event_id", "depth")


@query(
    f"WITH {_SPANSV}, m AS (SELECT event_type, min(event_id) AS module_def FROM e GROUP BY event_type) "
    "SELECT c.event_id, coalesce(arg_max(p.event_id, p.ord), any_value(m.module_def)) AS target FROM o c LEFT JOIN o p ON c.user_id IS NOT DISTINCT FROM p.user_id AND c.event_type = p.event_type AND p.s <= c.s AND p.t >= c.t AND p.ord < c.ord "
    "LEFT JOIN m ON m.event_type = c.event_type GROUP BY c.event_id"
)
def nearest_def_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest enclosing definition of the same name, else the module's first."""
    spans = intervals.place_in_order(event_spans(spark, sf_dir, 600.0), ["user_id"], "event_id")
    inner = intervals.containing(spans, spans, ["user_id", "event_type"], "left", strict=True).groupBy("event_id", "event_type").agg(F.max_by("o_event_id", "o_ord").alias("inner"))
    module = spans.groupBy("event_type").agg(F.min("event_id").alias("module_def"))
    return inner.join(module, "event_type", "left").select("event_id", F.coalesce("inner", "module_def").alias("target"))


# ----------------------------------------------------------------------- flow

_KEYWORDS = ["if", "return", "for", "else", "while", "case", "break"]
_KEYWORD_SQL = "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_KEYWORDS)) + " END"
_TOKENS = f"tk AS (SELECT user_id::VARCHAR AS fn_id, epoch_us(ts) * 1000 + event_id % 1000 AS pos, event_id, {_KEYWORD_SQL} AS keyword FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY fn_id ORDER BY pos, keyword) + 1 AS bi FROM tk)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("fn_id"), (_micros() * 1000 + F.col("event_id") % 1000).alias("pos"), "event_id", F.expr(_KEYWORD_SQL).alias("keyword"))


def _sql_block(index: str) -> str:
    return _sql_id("'cfg:block'", "fn_id", f"{index}::VARCHAR")


_EDGES = (
    "WITH "
    + _TOKENS
    + f""",
n AS (SELECT *, {_sql_block("bi")} AS bid, {_sql_block("0")} AS entry, {_sql_block("1")} AS ex, lag({_sql_block("bi")}) OVER (PARTITION BY fn_id ORDER BY bi) AS prev,
      lead(bi) OVER (PARTITION BY fn_id ORDER BY bi) IS NULL AS is_last FROM b WHERE bi < 2000),
ed AS (
  SELECT fn_id, 'seq' AS kind, coalesce(prev, entry) AS src, bid AS dst, NULL AS label FROM n
  UNION ALL SELECT fn_id, 'branch', bid, ex, keyword FROM n WHERE keyword IN ('if', 'elif', 'else', 'case', 'default', 'except', 'catch')
  UNION ALL SELECT fn_id, 'jump', bid, ex, keyword FROM n WHERE keyword IN ('return', 'break', 'continue')
  UNION ALL SELECT fn_id, 'fallthrough', bid, ex, NULL FROM n WHERE is_last)
"""
)


@query(_EDGES + "SELECT fn_id, src, dst FROM ed WHERE kind = 'seq'")
def cfg_seq_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.edges(tokens(spark, sf_dir)).filter(F.col("kind") == "seq").select("fn_id", "src", "dst")


@query(_EDGES + f"SELECT fn_id, kind, src, dst, label, {_sql_id(chr(39) + 'cfg:edge' + chr(39), 'fn_id', 'src', 'dst', 'coalesce(label, kind)')} AS edge_id FROM ed")
def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.edges(tokens(spark, sf_dir))


@query(_EDGES + "SELECT fn_id, label, count(*) AS n FROM ed WHERE kind = 'branch' GROUP BY fn_id, label")
def cfg_labelled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flow.edges(tokens(spark, sf_dir)).filter(F.col("kind") == "branch")
    return found.groupBy("fn_id", "label").agg(F.count("*").alias("n"))


@query(_EDGES + ", nb AS (SELECT fn_id, count(*) + 2 AS blocks FROM n GROUP BY fn_id), ne AS (SELECT fn_id, count(*) AS edges FROM ed GROUP BY fn_id) SELECT fn_id, blocks, edges FROM nb JOIN ne USING (fn_id)")
def cfg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.counts(tokens(spark, sf_dir))


@query("SELECT user_id AS fn_id, event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def dfg_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("fn_id"), F.col("event_type").alias("name"), "value", F.struct("ts", "event_id").alias("pos"))
    return flow.last_values(rows)


@query("SELECT p_partkey, p_name, regexp_matches(lower(p_name || CASE p_partkey % 4 WHEN 0 THEN '_URL' WHEN 1 THEN 'Bucket' ELSE '' END), 'path|url|uri|host|route|bucket|topic|queue|table|sql') AS pathlike FROM part")
def dfg_pathlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.expr("CASE p_partkey % 4 WHEN 0 THEN '_URL' WHEN 1 THEN 'Bucket' ELSE '' END"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", T.is_pathlike(name).alias("pathlike"))


@query("SELECT e.event_id, n.n_name AS name FROM events e JOIN nation n ON contains(lower(e.props), lower(substr(n.n_name, length(n.n_name) - 1, 2))) WHERE e.user_id % 25 = n.n_nationkey")
def use_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name is used in a call of its function if the call's text contains it."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fn_id"), "n_name", F.lower(F.expr("substr(n_name, length(n_name) - 1, 2)")).alias("name"), F.lit("lit:").alias("src"))
    called = table(spark, sf_dir, "events").select((F.col("user_id") % 25).cast("int").alias("fn_id"), F.col("event_id").alias("call"), F.lower("props").alias("preview"), F.col("event_id").alias("pos"))
    used = flow.used_facts(nation, called).join(nation.select("fn_id", "n_name"), "fn_id")
    return used.select(F.col("dst").alias("event_id"), F.col("n_name").alias("name"))


# -------------------------------------------------------------------- effects

_PATTERNS = [
    ("web", "web.click", "any", "http.route", "cl", None, 0),
    ("web", "web.view", "any", "http.route", "re:^v.*w", None, 0),
    ("web", "web.view", "any", "http.route", "view", None, 0),
    ("sql", "sql.buy", "python", "db.sql", "purchase", None, 2),
    ("sql", "sql.call", "python", "db.sql", None, "click", 0),
]
_PATTERN_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in p) + ")" for p in _PATTERNS)


def _rules(spark: SparkSession) -> DataFrame:
    rows = [(pack, pack, rule, language, language, kind, "p", "f", 0.9, "call", callee, method, least, None, [], None) for pack, rule, language, kind, callee, method, least in _PATTERNS]
    return spark.createDataFrame(rows, effects.RULE_SCHEMA)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), F.when(F.col("event_id") % 2 == 0, "python").otherwise("javascript").alias("language"),
        F.concat("event_type", F.when(F.col("event_id") % 3 == 0, F.lit("(x)")).otherwise(F.lit(""))).alias("preview"), (F.col("event_id") % 4).cast("int").alias("n_args"),
    )


@query(
    f"""
WITH p(pack, rule_id, language, kind, callee, object_method, arg_min) AS (VALUES {_PATTERN_VALUES}),
c AS (SELECT event_id AS call_id, CASE WHEN event_id % 2 = 0 THEN 'python' ELSE 'javascript' END AS language, event_type || CASE WHEN event_id % 3 = 0 THEN '(x)' ELSE '' END AS preview, event_id % 4 AS n_args FROM events)
SELECT DISTINCT call_id, rule_id FROM c JOIN p ON (p.language = 'any' OR p.language = c.language) AND n_args >= arg_min
  AND (callee IS NULL OR CASE WHEN callee LIKE 're:%' THEN regexp_matches(preview, substr(callee, 4)) ELSE contains(preview, callee) END)
  AND (object_method IS NULL OR contains(preview, object_method || '('))"""
)
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.matched(_calls(spark, sf_dir), _rules(spark)).select("call_id", "rule_id")


@query(
    """WITH c AS (SELECT o_orderkey AS call_id, o_custkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'typescript' END AS language, o_orderkey % 4 AS n_args FROM orders)
SELECT call_id, 'named.' || k AS rule_id FROM c JOIN customer ON c_custkey = k WHERE k % 3 <> 0 AND (k % 3 = 1 OR language = 'python')
UNION ALL SELECT call_id, 'method.' || k FROM c JOIN customer ON c_custkey = k WHERE k % 5 = 0 AND n_args >= 2
UNION ALL SELECT call_id, 'regex.' || k FROM c JOIN customer ON c_custkey = k WHERE k % 7 = 0
UNION ALL SELECT call_id, 'every' FROM c WHERE language = 'javascript'"""
)
def rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rules as there are customers, found by the rarest part of the text that they need."""
    spark = measured_session(spark)
    k = F.col("c_custkey").cast("string")
    customers = table(spark, sf_dir, "customer")

    def rules(name: str, language: Column | str, callee: Column | None, method: Column | None, least: int, which: Column) -> DataFrame:
        none = F.lit(None).cast("string")
        values = {
            "pack": F.lit("p"), "rule_id": F.concat(F.lit(name), k), "language": F.lit(language) if isinstance(language, str) else language, "pattern_language": F.lit("any"), "kind": F.lit("rpc"), "pattern_kind": F.lit("call"),
            "callee": none if callee is None else callee, "object_method": none if method is None else method, "arg_min": F.lit(least),
        }
        typed = types.StructType.fromDDL(effects.RULE_SCHEMA)
        return customers.filter(which).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in typed])

    number = F.col("c_custkey")
    found = rules("named.", F.when(number % 3 == 1, "any").otherwise("python"), F.concat(F.lit("client c"), k, F.lit(" .run")), None, 0, number % 3 != 0)
    found = found.union(rules("method.", "any", None, F.concat(F.lit("c"), k, F.lit(".run")), 2, number % 5 == 0))
    found = found.union(rules("regex.", "any", F.concat(F.lit(r"re:^client\.?c"), k, F.lit(r"\.r[a-z]+\(")), None, 0, number % 7 == 0))
    found = found.union(rules("every", "javascript", F.lit("re:^c|x"), None, 0, number == 1).withColumn("rule_id", F.lit("every")))
    key = F.col("o_orderkey")
    calls = table(spark, sf_dir, "orders").select(
        key.alias("call_id"), F.when(key % 3 == 0, "python").when(key % 3 == 1, "javascript").otherwise("typescript").alias("language"),
        F.concat(F.lit("clientc"), F.col("o_custkey").cast("string"), F.lit(".run(1)")).alias("preview"), (key % 4).cast("int").alias("n_args"),
    )
    return effects.matched(calls, found).select("call_id", "rule_id")


@query(
    f"""
WITH p(pack, rule_id, language, kind, callee, object_method, arg_min) AS (VALUES {_PATTERN_VALUES}),
c AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'python' ELSE 'javascript' END AS language FROM events)
SELECT c.language, rule_id, count(*) AS n FROM c JOIN (SELECT DISTINCT rule_id, language FROM p) r ON r.language IN ('any', c.language) GROUP BY c.language, rule_id"""
)
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that a rule is tried on, by language."""
    calls = _calls(spark, sf_dir).groupBy(F.col("language").alias("call_language")).agg(F.count("*").alias("n"))
    tried = effects.by_language(_rules(spark)).select("rule_id", "call_language").distinct()
    return calls.join(tried, "call_language").select(F.col("call_language").alias("language"), "rule_id", "n")


@query("SELECT DISTINCT event_type AS pack, 'WARN' AS severity, 'Rule pack not loaded' AS reason_detail FROM events WHERE event_type NOT IN ('web', 'sql', 'click')")
def rule_match_missing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark).select("pack").union(spark.createDataFrame([("click",)], "pack string"))
    return effects.missing_packs(table(spark, sf_dir, "events").select(F.col("event_type").alias("pack")).distinct(), rules)


@query(
    "WITH k(kind, sem, raw) AS (VALUES ('click', 'Call', 'call'), ('view', 'Symbol', 'callee_name'), ('purchase', 'Import', 'import')) "
    "SELECT event_id, event_type AS kind, coalesce(sem, 'Unknown') AS semantic_type, coalesce(raw, event_type) AS raw_kind, sem IS NULL AS is_unknown FROM events LEFT JOIN k ON event_type = kind"
)
def capture_kind_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(v) for k, kind in (("click", "call.expr"), ("view", "call.callee"), ("purchase", "import.stmt")) for v in (k, kind)])
    hit = captures.kind_of(F.try_element_at(kinds, F.col("event_type")))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("kind"), F.coalesce(hit["semantic"], F.lit("Unknown")).alias("semantic_type"), F.coalesce(hit["raw"], "event_type").alias("raw_kind"), hit.isNull().alias("is_unknown")
    )


@query("SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY event_type")
def unknown_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_kind_map(spark, sf_dir).filter("is_unknown").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS rn FROM events) WHERE rn <= 10")
def capture_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = captures.capped(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_type", "event_id", cap=10)
    return kept.select("user_id", "event_id", F.col("place").alias("rn"))


@query("SELECT user_id, count(*) - 10 AS dropped, 'CAPTURE_TRUNCATED' AS anomaly_type FROM events GROUP BY user_id HAVING count(*) > 10")
def capture_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, over = captures.capped(table(spark, sf_dir, "events"), ["user_id"], "event_id", cap=10)
    return over.select("user_id", "dropped", F.lit("CAPTURE_TRUNCATED").alias("anomaly_type"))


# ------------------------------------------------------------ report and store


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")).alias("run_id"), F.col("user_id").cast("string").alias("path"), "event_id", "ts",
        F.when(F.col("event_id") % 5 == 0, "hit").when(F.col("event_id") % 5 < 4, "miss").alias("cache_state"),
        F.when(F.col("event_id") % 11 > 0, F.floor(F.abs("value"))).cast("long").alias("parse_time_ms"), (F.col("event_id") % 100).alias("node_count"),
    )


_METRICS = (
    "mt AS (SELECT 'r' AS repo_id, 'run' || (event_id % 3) AS run_id, user_id::VARCHAR AS path, event_id, ts, CASE WHEN event_id % 5 = 0 THEN 'hit' WHEN event_id % 5 < 4 THEN 'miss' END AS cache_state, "
    "CASE WHEN event_id % 11 > 0 THEN floor(abs(value))::BIGINT END AS parse_time_ms, event_id % 100 AS node_count FROM events)"
)


@query(f"WITH {_METRICS} SELECT repo_id, path, run_id, event_id, ts FROM mt QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY ts DESC, event_id DESC) = 1")
def latest_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics(spark, sf_dir).select("repo_id", "path", "run_id", "event_id", "ts")
    return report.latest_by(rows, ["repo_id", "path"], F.col("ts").desc(), F.col("event_id").desc())


@query(f"WITH {_METRICS} SELECT trunc(quantile_cont(parse_time_ms, 0.5))::BIGINT AS p50, trunc(quantile_cont(parse_time_ms, 0.95))::BIGINT AS p95 FROM mt")
def report_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.parse_times(metrics(spark, sf_dir))


@query(f"WITH {_METRICS} SELECT coalesce(cache_state, 'unknown') AS cache_state, count(*) AS n FROM mt GROUP BY 1")
def report_cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cache_states(metrics(spark, sf_dir))


@query(f"WITH {_METRICS} SELECT run_id, round(count(*) FILTER (cache_state = 'hit') / greatest(count(*), 1), 4) AS hit_ratio FROM mt GROUP BY run_id")
def report_cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).groupBy("run_id").agg(report.hit_ratio().alias("hit_ratio"))


def stored_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    joined = labels.join(docs.select("doc_id", "source", "n_chars"), "doc_id")
    severity = F.when(F.col("toxic") == 1, "ERROR").when(F.col("quality") == 0, "WARN").otherwise("INFO")
    span = F.struct(F.col("n_chars").cast("int").alias("line_start"), F.lit(3).alias("col_start"), F.col("n_chars").cast("int").alias("line_end"), F.lit(9).alias("col_end"))
    return joined.select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("ts"), F.concat(F.lit("T_"), "source").alias("anomaly_type"), severity.alias("severity"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("reason_detail"), F.col("doc_id").cast("string").alias("path"), F.array(span).alias("spans"),
    )


_ANOMALIES = "an AS (SELECT doc_id, 'T_' || source AS anomaly_type, CASE WHEN toxic = 1 THEN 'ERROR' WHEN quality = 0 THEN 'WARN' ELSE 'INFO' END AS severity, n_chars FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_ANOMALIES} SELECT anomaly_type, severity, count(*) AS n FROM an GROUP BY 1, 2")
def report_anomaly_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.anomaly_histogram(stored_anomalies(spark, sf_dir))


@query(f"WITH {_ANOMALIES} SELECT 'UCG.' || anomaly_type AS \"ruleId\", CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARN' THEN 'warning' ELSE 'note' END AS level, anomaly_type || ': doc ' || doc_id AS message, doc_id::VARCHAR AS uri, (n_chars + 1)::INTEGER AS start_line, 4 AS start_column, 10 AS end_column FROM an WHERE severity IN ('ERROR', 'WARN')")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.sarif_results(stored_anomalies(spark, sf_dir), ["ERROR", "WARN"])
    return rows.select("ruleId", "level", "message", "uri", F.col("region.startLine").alias("start_line"), F.col("region.startColumn").alias("start_column"), F.col("region.endColumn").alias("end_column"))


@query(
    f"""WITH {_ANOMALIES}, l AS (
  SELECT doc_id, '{{"ruleId":"UCG.' || anomaly_type || '","level":"' || CASE severity WHEN 'ERROR' THEN 'error' ELSE 'warning' END || '","message":{{"text":"' || anomaly_type || ': doc ' || doc_id ||
    '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || doc_id || '"}},"region":{{"startLine":' || (n_chars + 1) || ',"startColumn":4,"endLine":' || (n_chars + 1) || ',"endColumn":10}}}}}}],"properties":{{"timestamp":""}}}}' AS j
  FROM an WHERE severity IN ('ERROR', 'WARN'))
SELECT CASE WHEN row_number() OVER (ORDER BY doc_id, j) = 1 THEN '' ELSE ',' END || j AS value FROM l
UNION ALL SELECT '{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"sourceloom","rules":[' ||
  (SELECT string_agg('{{"id":"UCG.' || anomaly_type || '"}}', ',' ORDER BY anomaly_type) FROM (SELECT DISTINCT anomaly_type FROM an WHERE severity IN ('ERROR', 'WARN'))) || ']}}}},"results":['
UNION ALL SELECT ']}}]}}'"""
)
def sarif_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the document; without the time of day, which depends on the session's zone."""
    lines = report.sarif_parts(report.sarif_results(stored_anomalies(spark, sf_dir), ["ERROR", "WARN"]))
    value = F.regexp_replace("value", r'"timestamp":"[^"]*"', '"timestamp":""')
    return lines.select(value.alias("value"))


@query(
    f"WITH {_METRICS} SELECT (SELECT count(*) FROM documents) AS files, (SELECT array_to_string(list_sort(list_distinct(list(lang))), ',') FROM documents) AS languages, "
    "trunc(quantile_cont(parse_time_ms, 0.5))::BIGINT AS parse_ms_p50, trunc(quantile_cont(parse_time_ms, 0.95))::BIGINT AS parse_ms_p95, coalesce(sum(node_count), 0)::BIGINT AS node_count, "
    "round(count(*) FILTER (cache_state = 'hit') / greatest(count(*), 1), 4) AS hit_ratio, (SELECT count(DISTINCT event_type) FROM events) AS effect_kinds FROM mt"
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"))
    found = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"))
    rows = report.run_report(files, metrics(spark, sf_dir), found, stored_anomalies(spark, sf_dir))
    return rows.select("files", F.array_join("languages", ",").alias("languages"), "parse_ms_p50", "parse_ms_p95", "node_count", "hit_ratio", F.size("effects_by_kind").cast("long").alias("effect_kinds"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def effects_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = [F.lit("r").alias(c) for c in ("repo_id", "run_id", "language", "provider", "family", "path", "blob_sha256", "owner_fn_id", "normalized_values", "receipt_id")]
    found = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), *prefix)
    return report.effects_by_kind(found).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_id::VARCHAR AS src_id, user_id::VARCHAR AS dst_id FROM events WHERE event_type IN ('click', 'view')")
def callsites_by_callee(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "calls").when(F.col("event_type") == "view", "instantiates").otherwise("imports")
    edges = table(spark, sf_dir, "events").select(
        F.lit("r").alias("repo_id"), F.lit("run").alias("run_id"), F.lit("p").alias("path"), F.lit("python").alias("language"), F.col("event_id").cast("string").alias("src_id"), F.col("user_id").cast("string").alias("dst_id"), F.array().alias("spans"), kind.alias("kind")
    )
    return report.callsites_by_callee(edges).select("src_id", "dst_id")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, 'new', max(o_totalprice) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return store.replace_by_key(old, new.select("c_custkey", F.lit("new").alias("c_name"), "c_acctbal"), ["c_custkey"])


@query(
    "WITH u AS (SELECT c_nationkey AS nation, c_name AS name, c_acctbal AS bal, 0 AS side FROM customer UNION ALL SELECT s_nationkey, s_name, s_acctbal, 1 FROM supplier) "
    "SELECT nation, name, bal FROM u QUALIFY row_number() OVER (PARTITION BY nation ORDER BY bal, name, side) = 1"
)
def edges_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two streams together, the first of each key kept."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.lit(0).alias("side"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), F.lit(1).alias("side"))
    return store.first_by_key(customers.unionByName(suppliers), ("nation",), "bal", "name", "side").select("nation", "name", "bal")


@query("SELECT symbol_id, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS first_use, count(*) AS uses FROM (SELECT *, substr(sha256('sym' || chr(0) || 'python' || chr(0) || l_partkey || chr(0) || 'callee' || chr(0) || chr(0)), 1, 24) AS symbol_id FROM lineitem) GROUP BY symbol_id")
def symbol_pk_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callee placeholders: one symbol per name, that of the first use."""
    symbol = ids.symbol_id(F.lit("python"), F.col("l_partkey"), "callee", F.lit(""))
    rows = table(spark, sf_dir, "lineitem").select(symbol.alias("symbol_id"), F.col("l_orderkey").alias("first_use"), "l_linenumber")
    uses = rows.groupBy("symbol_id").agg(F.count("*").alias("uses"))
    return graph.first_symbols(rows, "first_use", "l_linenumber").join(uses, "symbol_id").select("symbol_id", "first_use", "uses")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies of the virtual repository."""
    return discovery_tallies(spark, sf_dir)
