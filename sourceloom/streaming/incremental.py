"""Incremental runs: a stream of changed files whose results replace the old ones, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sourceloom.operators.discovery import Options
from sourceloom.plans.analyse import Analysis, analyse
from sourceloom.plans.staging import discard, stage_table
from sourceloom.plans.store import Store, conform
from sourceloom.sources import captures
from sourceloom.sources.rule_packs import Registry

CACHE_KEY = ("path", "blob_sha256", "grammar_fp", "query_fp")


def split_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Add cache_state: hit if the same file, content and fingerprints were analysed before."""
    known = cache.select(*CACHE_KEY).distinct().withColumn("_known", F.lit(True))
    return files.join(known, list(CACHE_KEY), "left").withColumn("cache_state", F.when(F.col("_known"), "hit").otherwise("miss")).drop("_known")


def analysing(registry: Registry, folder: str | Path, repo_id: str, run_id: str, packs: Sequence[str] | None = None, options: Options = Options()) -> Callable[[DataFrame], Analysis]:
    """What ``follow`` needs: the whole analysis of a batch (path, text, ...), with the rule packs as they are then.

    Packs that have been changed, or are new in ``folder``, hold from the next batch on.
    """

    def run(rows: DataFrame) -> Analysis:
        registry.refresh(folder)
        return analyse(rows.drop("repo_id", "run_id").withColumnRenamed("path", "rel_path"), registry.table(rows.sparkSession), repo_id, run_id, packs, options)

    return run


def follow(files: DataFrame, store: Store, tables_of: Callable[[DataFrame], dict[str, DataFrame] | Analysis], checkpoint: str, **trigger) -> StreamingQuery:
    """Analyse each micro-batch of changed files (repo_id, run_id, path, ...) and put its tables into the store.

    The batch's files replace their old rows in all tables, also where the new
    analysis finds nothing, and the batch's number is stored with them: a batch that
    comes again, as after a failure between the store's commit and the stream's,
    changes nothing.  All tables of a batch change together, and only the buckets of
    the changed files are written.  An ``Analysis`` is discarded when it is stored.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if store.holds((checkpoint, number)):
            return
        made = tables_of(rows)
        tables, looked = (made.tables, made.files) if isinstance(made, Analysis) else (made, rows)
        store.put_all(tables, files=looked, batch=(checkpoint, number))
        if isinstance(made, Analysis):
            made.discard()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Milliseconds after their last use for which results count as known.
KEEP_MS = 30 * 24 * 3600 * 1000


def with_cache_state(files: DataFrame, fingerprint: str, keep_ms: int = KEEP_MS) -> DataFrame:
    """Add cache_state to a stream of files (path, blob_sha256, ...): hit if the same content was seen last under this fingerprint.

    The state is keyed by path and fingerprint and holds a hash; each use renews its
    time, and what hasn't been used for ``keep_ms`` is forgotten.
    """
    columns = files.columns
    schema = T.StructType([*files.schema.fields, T.StructField("cache_state", T.StringType())])

    def look(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (last,) = state.get if state.exists else (None,)
        for part in parts:
            found = []
            for sha in part["blob_sha256"]:
                found.append("hit" if sha is not None and sha == last else "miss")
                last = sha
            yield part[columns].assign(cache_state=found)
        state.update((last,))
        state.setTimeoutDuration(keep_ms)

    keyed = files.withColumn("fingerprint_", F.lit(fingerprint)).groupBy("path", "fingerprint_")
    return keyed.applyInPandasWithState(look, schema, "blob_sha256 string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def follow_cached(files: DataFrame, store: Store, tables_of: Callable[[DataFrame], dict[str, DataFrame] | Analysis], checkpoint: str, fingerprint: str | None = None, keep_ms: int = KEEP_MS, **trigger) -> StreamingQuery:
    """Like ``follow``, but files whose content is known under the patterns' fingerprint aren't analysed again.

    Their newest metrics are marked as a hit instead.  A change of the patterns
    changes the fingerprint, and so every file is new.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if store.holds((checkpoint, number)):
            return
        held = stage_table(rows, "changed-files")  # the state is asked once
        made = tables_of(held.filter("cache_state = 'miss'").drop("cache_state"))
        tables, looked = (made.tables, made.files) if isinstance(made, Analysis) else (made, held.filter("cache_state = 'miss'"))
        hits = held.filter("cache_state = 'hit'").select("repo_id", "run_id", "path", "blob_sha256").distinct()
        known = store.read("metrics").drop("cache_state", "ts").join(hits, ["repo_id", "run_id", "path", "blob_sha256"])
        known = conform(known.withColumns({"cache_state": F.lit("hit"), "ts": F.current_timestamp()}), "metrics")
        metrics = known.unionByName(conform(tables["metrics"], "metrics")) if "metrics" in tables else known
        store.put_all({**tables, "metrics": metrics}, files=looked, batch=(checkpoint, number))
        if isinstance(made, Analysis):
            made.discard()
        discard(held)

    marked = with_cache_state(files, captures.fingerprint() if fingerprint is None else fingerprint, keep_ms)
    writer = marked.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    # what is too old goes with the next batch of files: batches without any would never end
    spark, key = files.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return writer.start()
    finally:
        spark.conf.set(key, before)
