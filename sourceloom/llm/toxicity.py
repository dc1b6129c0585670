"""Toxicity: a factorization machine over hashed terms.

The terms of a text are its lower-cased words and their 4- and 5-byte beginnings,
hashed to ``2 ** BITS`` places; a term counts once per text.  The score is
``sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)``, so that a pair of terms can
weigh more than its parts.

The model is fitted on the driver to at most ``SAMPLE`` labelled rows (a
documented bound); its size is fixed by ``TERMS`` and ``RANK``.  Its terms are
those that tell the classes apart by themselves, and, of the ``PAIR_TERMS`` most
frequent ones, those of which two together do so by more than the sum of both,
however little each one tells alone.

Defined results: null, empty and wordless texts get sigmoid(w0); without
labelled rows of both classes the score is the share of ones (0.5 without rows);
repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sourceloom.llm.common import free_name, release, releasing, row_chunks, text_buffers
from sourceloom.llm.labelled import held_out, labelled_sample
from sourceloom.llm.words import words

SAMPLE = 8000
BITS = 20
TERMS = 8192
RANK = 8
PREFIXES = (4, 5)
THRESHOLD = 0.3
MIN_COUNT = 5
MIN_CHI2 = 20.0
#: Frequent terms whose pairs are tested, rows that each part of a test needs, and its limit in standard deviations.
PAIR_TERMS = 1024
PAIR_ROWS = 5
MIN_PAIR = 7.0


def terms(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text and hashed term of every word and word beginning, repeats included."""
    w = words(data, offs)
    text_of, shift = w.text_of, np.uint64(64 - bits)
    texts, found = [text_of], [w.hashes]
    for k in PREFIXES:
        long = w.ends - w.starts > k
        texts.append(text_of[long])
        found.append(w.hasher(w.starts[long], w.starts[long] + k) * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate(texts), (np.concatenate(found) >> shift).astype(np.int64)


class FactorizationMachine:
    """Weights of the active terms; place[term] is -1 for all others."""

    def __init__(self, place: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.place, self.w0, self.w, self.v = place, w0, w, v

    def raw(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Score before the sigmoid of n texts, from (text, active term) pairs without repeats, sorted by text."""
        out = np.full(n, self.w0)
        if len(row):
            v = self.v[term]
            at = np.flatnonzero(np.diff(row, prepend=-1))
            s = np.add.reduceat(v, at, axis=0)
            out[row[at]] += np.add.reduceat(self.w[term], at) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), at))
        return out

    def pairs(self, text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        active = self.place[term]
        keep = active >= 0
        both = np.unique(text[keep] * len(self.w) + active[keep]) if len(self.w) else np.zeros(0, np.int64)
        return (both // max(1, len(self.w)), both % max(1, len(self.w)))

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = self.raw(*self.pairs(*terms(data, offs)), len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pair_terms(row: np.ndarray, term: np.ndarray, y: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The candidates that have a pair whose rate of ones isn't near the sum of what its parts add.

    For each pair the rates of rows with both, either one and none of the terms
    are compared; ``row`` and ``term`` are the distinct terms of the rows.
    """
    place = np.full(int(max(term.max(initial=0), candidates.max(initial=0))) + 1, -1, np.int64)
    place[candidates] = np.arange(len(candidates))
    known = place[term] >= 0
    x = np.zeros((len(y), len(candidates)), np.float32)
    x[row[known], place[term[known]]] = 1
    positive = x[y == 1]
    n, ones = x.sum(0), positive.sum(0)
    found = np.zeros(len(candidates), bool)
    for a in range(0, len(candidates), 128):
        part = slice(a, a + 128)
        both, both_ones = x[:, part].T @ x[:, a:], positive[:, part].T @ positive[:, a:]  # those before are done
        na, oa, nb, ob = n[part, None], ones[part, None], n[a:], ones[a:]
        counts = (both, na - both, nb - both, len(y) - na - nb + both)
        hits = (both_ones, oa - both_ones, ob - both_ones, y.sum() - oa - ob + both_ones)
        rates = [(h + 1) / (c + 2) for c, h in zip(counts, hits, strict=True)]
        spread = np.sqrt(sum(r * (1 - r) / (c + 2) for r, c in zip(rates, counts, strict=True)))
        strange = np.abs(rates[0] - rates[1] - rates[2] + rates[3]) >= MIN_PAIR * spread
        strange &= np.minimum.reduce(counts) >= PAIR_ROWS
        found[part] |= strange.any(1)
        found[a:] |= strange.any(0)
    return candidates[found]


def fit_machine(rows: list[np.ndarray], y: np.ndarray, rank: int = RANK, steps: int = 600, seed: int = 5) -> FactorizationMachine:
    """Adam over all rows; rows holds each text's distinct terms."""
    n, size = len(rows), 1 << BITS
    place = np.full(size, -1, np.int32)
    share = (y.sum() + 1) / (n + 2)
    w0 = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return FactorizationMachine(place, w0, np.zeros(0), np.zeros((0, rank)))
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    term = np.concatenate(rows).astype(np.int64)
    ones, zeros = np.bincount(term[y[row] == 1], minlength=size), np.bincount(term[y[row] == 0], minlength=size)
    n1, n0 = y.sum(), n - y.sum()
    total = ones + zeros
    det = ones * (n0 - zeros) - zeros * (n1 - ones)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.nan_to_num(n * det.astype(float) ** 2 / (n1 * n0 * total * (n - total).astype(float)))
    chosen = np.flatnonzero((total >= MIN_COUNT) & (chi2 >= MIN_CHI2))
    chosen = chosen[np.argsort(-chi2[chosen], kind="stable")[:TERMS]]
    frequent = np.flatnonzero(total >= MIN_COUNT)
    frequent = frequent[np.argsort(-total[frequent], kind="stable")[:PAIR_TERMS]]
    chosen = np.union1d(chosen, pair_terms(row, term, y, frequent))
    place[chosen] = np.arange(len(chosen))
    keep = place[term] >= 0
    row, term = row[keep], place[term[keep]].astype(np.int64)
    rng = np.random.default_rng(seed)
    theta = np.concatenate([rng.normal(0, 0.01, (len(chosen), rank)), np.zeros((len(chosen), 1))], axis=1)
    machine = FactorizationMachine(place, w0, theta[:, rank], theta[:, :rank])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    at = np.flatnonzero(np.diff(row, prepend=-1))
    m0 = s0 = 0.0
    for t in range(1, steps + 1):
        z = machine.raw(row, term, n)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.zeros_like(theta)
        if len(row):
            v = theta[term, :rank]
            sums = np.zeros((n, rank))
            sums[row[at]] = np.add.reduceat(v, at, axis=0)
            each = np.empty((len(row), rank + 1))
            each[:, :rank] = error[row, None] * (sums[row] - v)
            each[:, rank] = error[row]
            order = np.argsort(term, kind="stable") if t == 1 else order
            first = np.flatnonzero(np.diff(term[order], prepend=-1)) if t == 1 else first
            grad[term[order][first]] = np.add.reduceat(each[order], first, axis=0)
        grad += theta * 1e-5
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        rate = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        theta -= rate * m / (np.sqrt(s) + 1e-8)
        g0 = float(error.sum())
        m0, s0 = 0.9 * m0 + 0.1 * g0, 0.999 * s0 + 0.001 * g0 * g0
        machine.w0 -= rate * m0 / (s0**0.5 + 1e-8)
        machine.w, machine.v = theta[:, rank], theta[:, :rank]
    return machine


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> FactorizationMachine:
    """Fit to a bounded sample; the terms are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for i, j in row_chunks(offs):
                text, term = terms(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                both = np.unique((text << BITS) | term)
                cut = np.searchsorted(both, np.arange(j - i + 1) << BITS).astype(np.int32)
                each = pa.ListArray.from_arrays(pa.array(cut), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([each, batch.column("y").slice(i, j - i)], ["terms", "y"])

    table = labelled_sample(docs, labels, "toxic", bound).mapInArrow(releasing(run), "terms array<int>, y int").toArrow()
    y = table.column("y").to_numpy().astype(np.int64)
    rows = [x.values.to_numpy() for x in table.column("terms").combine_chunks()] if len(y) else []
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), int(rows[i].sum()), int(y[i])))  # the same whatever order tasks end in
    model = fit_machine([rows[i] for i in order], y[order] if len(y) else y)
    release()
    return model


def with_score(docs: DataFrame, model: FactorizationMachine) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and a score column, and that column's name."""
    held, name = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            out = [held.value.score(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in row_chunks(offs)]
            value = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, value], [*batch.schema.names, name])

    return docs.mapInArrow(releasing(run), StructType([*docs.schema.fields, StructField(name, DoubleType())])), name


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored, name = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    scored, name = with_score(docs, model)
    return scored.filter(F.col(name) < threshold).drop(name)
