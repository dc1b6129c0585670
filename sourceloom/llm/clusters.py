"""Centroid clustering with an incremental distance matrix.

Vectors and centroids are integers, and a squared distance is |v|^2 - 2 v.c + |c|^2.
Each vector keeps its exact dot products with all centroids.  When centroids have
moved, a vector's products change by its components times those components' changes,
so only components with a nonzero change are touched; then the nearest centroid is
found again from the products alone.  A round without any change is the last one
that needs work.

The state (vector, products, cluster, last cluster) is a table of its own for each
round, written by tasks that need no shuffle; the tables before it are discarded.
Sums of the clusters are kept in the same way: only vectors that have changed their
cluster are added and taken away, first in each task.  The driver holds centroids
and sums, a few numbers for each centroid.

Defined results: vectors that are null, of another length than ``dim``, or hold null
or non-finite components are left out; a null id stands after all others when
centroids are chosen, and ids that tie (repeated rows) are ordered by their vectors;
with fewer vectors than centroids there are as many centroids as vectors; empty
clusters keep their centroid; repeated rows are separate vectors; an empty table
gives no rows; only the id and vector columns are read, so others can't clash.
Arithmetic is modulo 2^64, so a distance is exact if it fits 63 bits: all do with
|x| up to 131072, and a larger component is an error rather than a wrong result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import discard, releasing, stage_table

DIM = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Largest component after scaling: 64 squares of twice that are below 2 ** 63.
LIMIT = 1 << 27
_STATE = "vec_id long, v array<long>, dots array<long>, norm long, cluster int, last int"


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of the components, x as double."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter((F.size("x") == dim) & F.coalesce(finite, F.lit(False)))
    large = F.exists("x", lambda x: F.abs(x) * scale > LIMIT)
    checked = F.when(large, F.raise_error(F.lit(f"a component is over {LIMIT / scale:.0f}"))).otherwise(F.transform("x", lambda x: F.floor(x * scale).cast("long")))
    return rows.select("vec_id", checked.alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.int64()))


def nearest(dots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row of products, the smaller number on a tie."""
    return ((centroids * centroids).sum(axis=1) - 2 * dots).argmin(axis=1)


def _begin(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The first state: all products, and the clusters of the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), batch.num_rows)
            dots = v @ centroids.T
            cluster = pa.array(nearest(dots, centroids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), _lists(dots), pa.array((v * v).sum(axis=1)), cluster, pa.array(np.full(len(v), -1, np.int32))], ["vec_id", "v", "dots", "norm", "cluster", "last"])

    return vectors.mapInArrow(releasing(run), _STATE)


def _advance(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The next state: products moved by the centroids' nonzero changes, and new clusters."""
    change = new - old

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = [(j, np.flatnonzero(change[j])) for j in np.flatnonzero(change.any(axis=1))]
        for batch in batches:
            v, dots = _matrix(batch.column("v"), batch.num_rows), _matrix(batch.column("dots"), batch.num_rows).copy()
            for j, at in moved:
                dots[:, j] += v[:, at] @ change[j, at]
            cluster = pa.array(nearest(dots, new).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), _lists(dots), batch.column("norm"), cluster, batch.column("cluster")], ["vec_id", "v", "dots", "norm", "cluster", "last"])

    return state.mapInArrow(releasing(run), _STATE)


def _shifts(state: DataFrame, k: int, dim: int) -> tuple[list[int], list[list[int]]]:
    """By how much clusters' sizes and sums change: of rows that have another cluster than in the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            v = np.column_stack([_matrix(batch.column("v"), batch.num_rows), np.ones(batch.num_rows, np.int64)])
            cluster, last = batch.column("cluster").to_numpy(), batch.column("last").to_numpy()
            np.add.at(total, cluster, v)
            np.subtract.at(total, last[last >= 0], v[last >= 0])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    parts = state.filter("cluster <> last").select("v", "cluster", "last").mapInArrow(releasing(run), "at long, n long")
    total = [[0] * (dim + 1) for _ in range(k)]
    for at, n in parts.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)"))).collect():  # k * (dim + 1) numbers at most
        total[at // (dim + 1)][at % (dim + 1)] = int(n)
    return [row[dim] for row in total], [row[:dim] for row in total]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    rows = integer_vectors(vectors, dim, scale)
    centroids = first_centroids(rows, k, seed)
    k = len(centroids)
    if not k:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = stage_table(_begin(rows, centroids), "clusters")
    sizes, sums = [0] * k, [[0] * dim for _ in range(k)]
    for _ in range(rounds):
        more, shift = _shifts(state, k, dim)
        sizes = [a + b for a, b in zip(sizes, more, strict=True)]
        sums = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(sums, shift, strict=True)]
        new = np.array([[s // n for s in total] if n else old.tolist() for n, total, old in zip(sizes, sums, centroids, strict=True)], np.int64)
        if (new == centroids).all():
            break  # clusters would stay as they are in all further rounds
        before, state = state, stage_table(_advance(state, centroids, new), "clusters")
        discard(before)
        centroids = new
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    lengths = F.array(*[F.lit(int((c * c).sum())) for c in centroids])
    own = F.col("cluster") + 1
    placed = state.select("vec_id", "cluster", (F.col("norm") - 2 * F.element_at("dots", own) + F.element_at(lengths, own)).alias("distance"))
    by_cluster = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows
    inertia = F.array(*[F.lit(by_cluster.get(j, 0)).cast("long") for j in range(k)])
    return placed.select(
        "vec_id", "cluster", "distance", F.element_at(inertia, own).alias("cluster_inertia"), F.lit(sum(by_cluster.values())).cast("long").alias("inertia"),
        F.element_at(F.array(*[F.lit(h) for h in hashes]), own).alias("centroid_sha256"),
    )
