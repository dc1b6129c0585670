"""The registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm import clusters, decontaminate, divergence, language_id, mixing, multi_index, near_dup, quality, repeats, reshard, token_ids, toxicity, warc
from sourceloom.llm.common import read_table, stage_path

SHARDS = 40
TOKENIZER = "word_bpe_49k.json"


def tokenizer_json(name: str = TOKENIZER) -> str:
    """The text of a public tokenizer file (a few MB), read on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = stage_path(spark, "reshard-files")
    placed = reshard.reshard_files(docs, SHARDS, path)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return decontaminate.digest(decontaminate.find_hits(docs, read_table(spark, sf_dir, "benchmark")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(read_table(spark, sf_dir, "pages")))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_ids.write_shards(read_table(spark, sf_dir, "documents"), tokenizer_json())
    return token_ids.read_shards(path, spark)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(read_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(read_table(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def _centroid_sql(rounds: int = clusters.ROUNDS, k: int = clusters.CENTROIDS) -> str:
    """The rounds one after the other, each as two tables."""
    d = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        "e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM e ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT e.rid, c.j, {d} AS d FROM e, c{r} c) GROUP BY rid)")
        if r < rounds:
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM "
                f"(SELECT j, pos, sum(x) AS s, count(*) AS n FROM (SELECT a.j, unnest(range(1, 65)) AS pos, unnest(e.v) AS x FROM a{r} a JOIN e USING (rid)) GROUP BY j, pos) GROUP BY j) n USING (j))"
            )
    return (
        "WITH " + ", ".join(parts) + f" SELECT e.vec_id, a.j::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN e USING (rid) JOIN c{rounds} c USING (j)"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_repeats": op3_repeats,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_warc": op6_warc,
    "op7_token_ids": op7_token_ids,
    "op8_nearest": op8_nearest,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_divergence": op11_divergence,
    "op12_centroids": op12_centroids,
    "op13_language": op13_language,
}

ORACLES: dict[str, str] = {
    "op5_decontamination": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bl AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[k : k + n - 1], ' ') AS w FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM bl)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, k, array_to_string(ws[k : k + n - 1], ' ') AS w FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, lens WHERE len(ws) >= n)),
hits AS (SELECT rid, k, dw.n, item_id FROM dw JOIN bw USING (n, w)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hits) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
""",
    "op6_warc": r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
""",
    "op10_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')) AS k
  FROM documents),
placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS lo,
         (sum(size) OVER (PARTITION BY source))::BIGINT AS source_size
  FROM sized),
s0 AS (SELECT source, max(source_size) AS source_size FROM placed GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0),
s2 AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap, (SELECT sum(source_size) FROM s1)::BIGINT AS total FROM s1),
s3 AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
         (sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight
  FROM s2),
s4 AS (SELECT *, weight * rest > cap * open_weight AS is_capped FROM s3),
lv AS (SELECT rest AS r, open_weight AS w FROM s4 WHERE NOT is_capped ORDER BY rest DESC, open_weight DESC LIMIT 1),
s5 AS (SELECT s4.*, CASE WHEN is_capped THEN cap::DOUBLE ELSE (weight * r)::DOUBLE / w::DOUBLE END AS target FROM s4, lv),
seats AS (SELECT round(sum(target) / 64)::BIGINT AS seats FROM s5),
q AS (
  SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS rk
  FROM (SELECT place, target, unnest(range(0, (ceil(target / 64) + 9)::BIGINT)) AS k FROM s5 WHERE target > 0)),
quota AS (SELECT place, count(*) AS quota FROM q, seats WHERE rk <= seats GROUP BY place),
p AS (
  SELECT source, source_size, target, greatest(ceil(source_size / 64)::BIGINT, 1) AS blocks, coalesce(quota, 0) AS quota,
         ('0x' || substr(md5('17:' || coalesce(source, '')), 1, 8))::BIGINT AS seed
  FROM s5 LEFT JOIN quota USING (place)),
r AS (
  SELECT *, least(quota // blocks, 3) AS passes, CASE WHEN quota // blocks < 3 THEN quota % blocks ELSE 0 END AS run, seed % blocks AS run_start FROM p),
t AS (
  SELECT d.doc_id, d.size, d.source_size, r.target, r.passes, d.lo, d.lo + d.size AS hi, r.run_start * 64 AS a, (r.run_start + r.run) * 64 AS b,
         (r.run_start + r.run - r.blocks) * 64 AS c
  FROM placed d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(least(hi, b) - greatest(lo, a), 0) + greatest(least(hi, c) - greatest(lo, 0), 0))::BIGINT AS taken
FROM t
""",
    "op11_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
t AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS cl FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
nl AS (SELECT lang, sum(cl) AS n, count(*) AS v FROM k GROUP BY lang),
ng AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(ng.n, 0)::HUGEINT + 2 * nl.v) AS p, 1 + (1000000000::HUGEINT * (k.cl + 2)) // (nl.n::HUGEINT + 2 * nl.v) AS q
  FROM g JOIN k USING (lang) JOIN nl USING (lang) LEFT JOIN ng ON ng.lang = g.lang AND ng.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
ps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pr AS (SELECT g.lang, g.source, h.source AS item, coalesce(ps.value, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN ps ON ps.lang = g.lang AND ps.source = g.source AND ps.item = h.source),
tr AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // (p + q) DESC, term) AS rank
  FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pr
UNION ALL SELECT lang, source, 'term', item, value, rank::INTEGER FROM tr WHERE rank <= 10
""",
    "op12_centroids": _centroid_sql(),
}
