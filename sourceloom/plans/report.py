"""Run reports, views and SARIF rows over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.functions import fixed
from sourceloom.operators.discovery import tallies
from sourceloom.plans.staging import stage_table


def latest_by(rows: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """The newest row of each key; ``newest`` orders them and must leave no ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def parse_times(metrics: DataFrame) -> DataFrame:
    """Exact p50 and p95 of parse_time_ms, cut to whole numbers; null for no rows."""
    p = F.percentile("parse_time_ms", F.array(F.lit(0.5), F.lit(0.95)))
    return metrics.filter(F.col("parse_time_ms").isNotNull()).agg(p.alias("p")).select(F.col("p")[0].cast("long").alias("p50"), F.col("p")[1].cast("long").alias("p95"))


def cache_states(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(F.coalesce("cache_state", F.lit("unknown")).alias("cache_state")).agg(F.count("*").alias("n"))


def hit_ratio() -> Column:
    return F.round(F.count_if(F.col("cache_state") == "hit") / F.greatest(F.count("*"), F.lit(1)), 4)


def anomaly_histogram(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("anomaly_type", "severity").agg(F.count("*").alias("n"))


def run_report(files: DataFrame, metrics: DataFrame, effects: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row: every part of the report."""
    p = F.percentile("parse_time_ms", F.array(F.lit(0.5), F.lit(0.95)))
    one = metrics.agg(p[0].cast("long").alias("parse_ms_p50"), p[1].cast("long").alias("parse_ms_p95"), F.coalesce(F.sum("node_count"), F.lit(0)).cast("long").alias("node_count"), hit_ratio().alias("hit_ratio"))
    kinds = effects.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("effects_by_kind"))
    histogram = anomaly_histogram(anomalies).agg(F.sort_array(F.collect_list(F.struct("anomaly_type", "severity", "n"))).alias("anomalies"))
    listed = files.agg(F.count("*").alias("files"), F.sort_array(F.collect_set("language")).alias("languages"))
    return listed.crossJoin(one).crossJoin(kinds).crossJoin(histogram)  # one row each


def discovery_report(decided: DataFrame, found: DataFrame, folders: int | None = None) -> DataFrame:
    """One row: the time, the tallies of ``discovery.tallies`` and the folders seen as a struct, and the anomalies by type and severity."""
    histogram = anomaly_histogram(found).agg(F.sort_array(F.collect_list(F.struct("anomaly_type", "severity", "n"))).alias("anomalies"))
    counted = tallies(decided)
    return counted.select(F.current_timestamp().alias("finished_at"), F.struct(F.lit(folders).cast("long").alias("dirs_seen"), *counted.columns).alias("tallies")).crossJoin(histogram)  # one row each


def effects_by_kind(effects: DataFrame) -> DataFrame:
    return effects.select("repo_id", "run_id", "language", "kind", "provider", "family", "path", "blob_sha256", "owner_fn_id", "normalized_values", "receipt_id")


def callsites_by_callee(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("kind").isin("calls", "instantiates")).select("repo_id", "run_id", "path", "language", "src_id", "dst_id", "spans")


def sarif_level(severity: Column) -> Column:
    level = F.lit("note")
    for name, value in fixed.SARIF_LEVELS.items():
        level = F.when(F.upper(severity) == name, F.lit(value)).otherwise(level)
    return level


def sarif_results(anomalies: DataFrame, severities: list[str]) -> DataFrame:
    """ruleId, level, message, uri, 1-based region (null without spans) and blob_sha256 of each anomaly."""
    span = F.get("spans", F.lit(0)) if "spans" in anomalies.columns else F.lit(None).cast("struct<line_start:int,col_start:int,line_end:int,col_end:int>")
    region = F.when(span.isNotNull(), F.struct(*[(F.greatest(F.coalesce(span[c], F.lit(0)), F.lit(0)) + 1).alias(n) for c, n in (("line_start", "startLine"), ("col_start", "startColumn"), ("line_end", "endLine"), ("col_end", "endColumn"))]))
    sha = F.col("blob_sha256") if "blob_sha256" in anomalies.columns else F.lit(None).cast("string")
    kept = anomalies.filter(F.col("severity").isin(*severities))
    return kept.select("ts", F.concat(F.lit("UCG."), "anomaly_type").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.trim(F.concat("anomaly_type", F.lit(": "), F.coalesce("reason_detail", F.lit("")))).alias("message"), F.col("path").alias("uri"), region.alias("region"), sha.alias("blob_sha256"))


def sarif_lines(results: DataFrame) -> DataFrame:
    """ts, uri, json: the SARIF text of each result."""
    body = F.struct(
        F.col("ruleId"), F.col("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), "region").alias("physicalLocation"))).alias("locations"),
        F.struct("blob_sha256", F.col("ts").cast("string").alias("timestamp")).alias("properties"),
    )
    return results.select("ts", "uri", F.to_json(body).alias("json"))


def sarif_parts(results: DataFrame) -> DataFrame:
    """nth, value: the lines of one SARIF 2.1.0 document in their order, of as many results as there are, by time.

    Results are sorted by ranges and numbered where they lie; the first of all has no
    comma before it.  Head and tail are lines of their own, and only the distinct
    rules, as many as there are kinds of anomalies, stand in one of them.
    """
    placed = stage_table(sarif_lines(results).orderBy("ts", "uri", "json").withColumn("nth", F.monotonically_increasing_id()), "sarif")
    least = placed.agg(F.coalesce(F.min("nth"), F.lit(0))).first()[0]
    lines = placed.select("nth", F.concat(F.when(F.col("nth") == least, "").otherwise(","), "json").alias("value"))
    rules = F.to_json(F.transform(F.sort_array(F.collect_set("ruleId")), lambda r: F.struct(r.alias("id"))))
    head = results.agg(F.concat(F.lit('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"sourceloom","rules":'), rules, F.lit('}},"results":[')).alias("value"))
    tail = results.sparkSession.createDataFrame([((1 << 63) - 1, "]}]}")], "nth long, value string")
    return head.select(F.lit(-1).cast("long").alias("nth"), "value").union(lines).union(tail)


def save_sarif(results: DataFrame, folder: str) -> None:
    """Write the document as text files: joined in the order of their names, they are one JSON text."""
    sarif_parts(results).orderBy("nth").select("value").write.mode("overwrite").text(folder)


def save_json(report: DataFrame, folder: str) -> None:
    """Write a report's rows as JSON lines."""
    report.write.mode("overwrite").json(folder)
