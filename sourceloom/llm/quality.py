"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each text (lengths, shares of byte classes, repeats of words and
lines) are computed with numpy on the executors; the trees are grown on the
driver from at most ``SAMPLE`` labelled rows (a documented bound), as histograms
of at most ``BINS`` bins, and flattened to arrays in heap order for traversal.

Defined results: null and empty texts have all statistics 0 and are scored like
any other; without labelled rows of both classes the score is the share of ones
(0.5 without rows); repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import releasing, row_chunks, text_buffers
from sourceloom.llm.labelled import held_out, labelled_sample
from sourceloom.llm.words import LOWER, SpanHasher, mix, runs

SAMPLE = 20000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
L2 = 1.0
MIN_ROWS = 10
THRESHOLD = 0.7

_B = np.arange(256)
#: Byte classes whose shares are statistics.
CLASSES = {
    "upper": (_B >= 65) & (_B <= 90),
    "lower": (_B >= 97) & (_B <= 122),
    "digit": (_B >= 48) & (_B <= 57),
    "space": _B == 32,
    "newline": _B == 10,
    "high": _B >= 128,
    "stop": np.isin(_B, [44, 46, 58, 59]),
    "loud": np.isin(_B, [33, 63]),
    "bar": _B == 124,
    "slash": np.isin(_B, [47, 92]),
    "bracket": np.isin(_B, [40, 41, 60, 62, 91, 93, 123, 125]),
    "symbol": np.isin(_B, [35, 36, 37, 38, 42, 43, 61, 64, 94, 95, 126]),
}
NAMES = ["bytes", *CLASSES, "words", "word_mean", "word_max", "same_as_last", "same_as_last_but_one", "distinct", "top_word", "pairs_distinct", "lines", "line_mean", "line_distinct"]


def _per_text(values: np.ndarray, first: np.ndarray, how: np.ufunc) -> np.ndarray:
    """Reduce values[first[i]:first[i + 1]]; 0 for none."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = how.reduceat(values, first[:-1][full])
    return out


def _repeats(keys: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and the count of its most frequent one."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    salted = mix(keys ^ mix(text_of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(salted)
    at = np.flatnonzero(np.concatenate([[True], salted[order][1:] != salted[order][:-1]]))
    count = np.diff(np.append(at, len(keys)))
    owner = text_of[order[at]]
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    return np.bincount(owner, minlength=n).astype(float), top


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    safe = np.maximum(size, 1)
    columns = [np.log1p(size)]
    for flags in CLASSES.values():
        total = np.concatenate([[0], np.cumsum(flags[data])])
        columns.append((total[offs[1:]] - total[offs[:-1]]) / safe)
    hasher = SpanHasher(LOWER[data])
    starts, ends = runs(data > 32, offs)
    first = np.searchsorted(starts, offs)
    text_of = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(float)
    count = np.diff(first).astype(float)
    hashes = hasher(starts, ends)
    words = np.maximum(count, 1)
    columns += [np.log1p(count), _per_text(length, first, np.add) / words, np.log1p(_per_text(length, first, np.maximum))]
    for k in (1, 2):
        same = np.zeros(len(hashes))
        if len(hashes) > k:
            same[k:] = (hashes[k:] == hashes[:-k]) & (text_of[k:] == text_of[:-k])
        columns.append(_per_text(same, first, np.add) / words)
    distinct, top = _repeats(hashes, text_of, n)
    columns += [distinct / words, top / words]
    if len(hashes) > 1:
        inside = text_of[1:] == text_of[:-1]
        pairs, _ = _repeats((hashes[1:] * np.uint64(3) + hashes[:-1])[inside], text_of[1:][inside], n)
    else:
        pairs = np.zeros(n)
    columns.append(pairs / np.maximum(count - 1, 1))
    a, b = runs(data != 10, offs)
    line_first = np.searchsorted(a, offs)
    lines = np.diff(line_first).astype(float)
    line_distinct, _ = _repeats(hasher(a, b), np.repeat(np.arange(n), np.diff(line_first)), n)
    columns += [np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), line_distinct / np.maximum(lines, 1)]
    return np.stack(columns, axis=1)


class Trees:
    """Flattened trees in heap order: the children of node i are 2 i + 1 and 2 i + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.size else 0
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            z += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Level-wise growth from gradient histograms, logistic loss."""
    n, inner = len(y), 2**depth - 1
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    k_all, width = x.shape[1], BINS
    flat = bins + np.arange(k_all) * width
    z = np.full(n, base)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (k_all * width) + flat).ravel()
            shape = (nodes, k_all, width)
            hist = [np.bincount(key, np.repeat(v, k_all), nodes * k_all * width).reshape(shape).cumsum(2) for v in (g, h, np.ones(n))]
            gl, hl, nl = (v[:, :, :-1] for v in hist)
            gt, ht, nt = (v[:, :, -1:] for v in hist)
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(nl < MIN_ROWS) | (nt - nl < MIN_ROWS)] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            for i in range(nodes):
                k, b = divmod(int(best[i]), width - 1)
                if gain[i, k, b] > 1e-6 and b < len(cuts[k]):
                    feature[first + i], cut[first + i] = k, cuts[k][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        z += value[leaf]
        features.append(feature)
        limits.append(cut)
        leaves.append(value)
    return Trees(base, np.array(features), np.array(limits), np.array(leaves))


def _map(docs: DataFrame, per_batch, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            parts = [per_batch(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in row_chunks(offs)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.concat_arrays(parts) if parts else per_batch(data[:0], offs[:1] * 0)], [*columns, "out"])

    return docs.mapInArrow(releasing(run), schema)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Trees:
    """Fit to a bounded sample; statistics are made on the executors."""

    def stats(data: np.ndarray, offs: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(statistics(data, offs).ravel()), len(NAMES)).cast(pa.list_(pa.float64()))

    table = _map(labelled_sample(docs, labels, "quality", bound), stats, ["y"], "y int, out array<double>").toArrow()
    y = table.column("y").to_numpy().astype(np.int64)
    x = table.column("out").combine_chunks().values.to_numpy().reshape(len(y), len(NAMES)) if len(y) else np.zeros((0, len(NAMES)))
    order = np.lexsort([*x.T, y])  # the same whatever order tasks end in
    return fit_trees(x[order], y[order])


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(data: np.ndarray, offs: np.ndarray) -> pa.Array:
        return pa.array(held.value.score(statistics(data, offs)), pa.float64())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = _map(rows, scores, ["doc_id"], "doc_id long, out double").withColumnRenamed("out", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
