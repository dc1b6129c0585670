"""Nearest neighbours by multi-index hashing.

Vectors get binary codes: the signs of a learned rotation of their principal
components (iterative quantisation), fitted on a bounded sample.  A code is cut
into substrings of 16 bits.  Two codes within Hamming distance r agree in some
substring up to floor(r / m) bits, so probing every substring's buckets within
that distance finds every code within r.  What is found is reranked by the exact
Euclidean distance of the original vectors in double precision.

The radius is the smallest that keeps ``SAMPLE_RECALL`` of the sample's own
neighbours (neighbours in the whole table are nearer than those in a sample).
Queries that find fewer than the wanted number within it search all codes.

Equal vectors are one class, and a class only needs its ``k + 1`` smallest ids.
The index holds a class once for each substring, dealt by the substring and its
leading bits to groups of bounded size (frequent leading bits to several).  A
query goes to the groups that it may probe, and a group that many probe is there
several times, each time for some of the queries; a code that several substrings bring
is reranked for the first one only, and only a group's best few go on.

Defined results: null ids, and vectors that are null, empty, zero or hold null
or non-finite components take no part; repeated rows of an id and vector count
once, and all rows of the query's own id are left out; vectors of another length
than the query's are no candidates; distances of very large or small finite
numbers are scaled, so that they don't overflow or vanish; an empty table gives no rows; only the id
and vector columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import discard, releasing, releasing_groups, stage_table

K = 10
EVERY = 100
SAMPLE = 8192
SAMPLE_QUERIES = 256
SAMPLE_RECALL = 0.98
MAX_BITS = 64
SUBSTRING = 16
#: Classes in a group of the index, about.
GROUP_ROWS = 16384
#: Queries that search a group together, about; where there are more, the group is there once for each lot of them.
QUERY_ROWS = 4096

_POP = np.array([bin(i).count("1") for i in range(1 << SUBSTRING)], np.uint8)


class Codes:
    """Learned rotation of scaled vectors; ``radius`` is the Hamming radius to search."""

    def __init__(self, scale: float, mean: np.ndarray, rotation: np.ndarray, radius: int) -> None:
        self.scale, self.mean, self.rotation, self.radius = scale, mean, rotation, radius
        self.count = -(-rotation.shape[1] // SUBSTRING)  # of substrings

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit numbers."""
        with np.errstate(all="ignore"):  # vectors far larger than those of the sample
            bits = (x / self.scale - self.mean) @ self.rotation > 0
        pad = -bits.shape[1] % SUBSTRING
        return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint16)


def fit_codes(x: np.ndarray, k: int = K, rounds: int = 30, seed: int = 3) -> Codes:
    """Iterative quantisation of a sample, and its radius."""
    n, dim = x.shape
    scale = float(np.abs(x).max(initial=0.0)) or 1.0
    x = x / scale
    mean, bits = x.mean(axis=0), min(dim, MAX_BITS)
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = vectors[:, ::-1][:, :bits]
    z = (x - mean) @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(z @ r).T @ z)
        r = (u @ vt).T
    codes = Codes(scale, mean, axes @ r, bits)
    if n > k + 1:
        own = codes.substrings(x * scale)
        near = []
        for i in range(0, n, max(1, n // SAMPLE_QUERIES)):
            d = ((x - x[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            best = np.argpartition(d, k)[:k]
            near.append(_POP[own[best] ^ own[i]].sum(axis=1))
        codes.radius = int(np.quantile(np.concatenate(near), SAMPLE_RECALL, method="higher"))
    return codes


def distances(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; scaled where squares would overflow or vanish."""
    with np.errstate(over="ignore"):
        d = np.sqrt(((vectors - q) ** 2).sum(axis=1))
        odd = np.flatnonzero(~(d > 1e-140) | ~(d < 1e140))
        if len(odd):
            diff = np.abs(vectors[odd] - q)
            top = diff.max(axis=1)
            plain = (top == 0) | ~np.isfinite(top)
            scale = np.where(plain, 1.0, top)
            d[odd] = np.where(plain, top, scale * np.sqrt(((diff / scale[:, None]) ** 2).sum(axis=1)))
    return d


class Layout:
    """Groups of the index: substrings by their leading ``bits``, each in as many pieces as its size asks for."""

    def __init__(self, counts: np.ndarray, bits: int, group_rows: int) -> None:
        self.bits, self.pieces = bits, -(-counts // group_rows)  # substrings x leading bits
        self.first = (np.cumsum(self.pieces) - self.pieces.ravel()).reshape(self.pieces.shape)

    def lead(self, values: np.ndarray) -> np.ndarray:
        return values.astype(np.int64) >> (SUBSTRING - self.bits)

    def group(self, j: int, values: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The group of each substring number ``j``."""
        lead = self.lead(values)
        return self.first[j, lead] + salt % self.pieces[j, lead]

    def substring_of(self, group: int) -> int:
        return int(np.searchsorted(self.first[:, 0], group, side="right")) - 1

    def probed(self, code: np.ndarray, reach: int) -> np.ndarray:
        """The groups that may hold a substring within ``reach`` bits of that of ``code``."""
        parts = []
        for j, value in enumerate(code):
            near = np.flatnonzero((_POP[np.arange(self.pieces.shape[1]) ^ self.lead(value)] <= reach) & (self.pieces[j] > 0))
            size = self.pieces[j, near]
            parts.append(np.repeat(self.first[j, near] - (np.cumsum(size) - size), size) + np.arange(size.sum()))
        return np.concatenate(parts)


class Buckets:
    """The codes of a group by their substring ``j``."""

    def __init__(self, subs: np.ndarray, j: int) -> None:
        self.subs, self.j = subs, j
        self.order = np.argsort(subs[:, j], kind="stable")
        self.values, first = np.unique(subs[self.order, j], return_index=True)
        self.first = np.append(first, len(subs))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within the radius whose first substring within the pigeonhole's reach is that of this group."""
        reach = radius // len(code)
        near = np.flatnonzero(_POP[self.values ^ code[self.j]] <= reach)  # the group's buckets are few
        size = self.first[near + 1] - self.first[near]
        rows = self.order[np.repeat(self.first[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        apart = _POP[self.subs[rows] ^ code]
        return rows[(apart.sum(axis=1, dtype=np.int64) <= radius) & (apart[:, : self.j] > reach).all(axis=1)]


def search_group(queries: np.ndarray, vectors: np.ndarray, codes: Codes, j: int, radius: int, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, rows and distances of the ``wanted`` nearest that substring ``j`` brings, and ties of the last."""
    buckets = Buckets(codes.substrings(vectors), j)
    for q, code in zip(queries, codes.substrings(queries), strict=True):
        rows = buckets.within(code, radius)
        d = distances(vectors[rows], q)
        if len(rows) > wanted:  # all that tie with the last one stay: ids decide later
            near = d <= np.partition(d, wanted - 1)[wanted - 1]
            rows, d = rows[near], d[near]
        yield rows, d


def _usable(vector: Column) -> Column:
    """Not null, not zero, finite throughout."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest vectors of each query row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("x")))
    rows = rows.withColumn("x", F.transform("x", lambda v: v + F.lit(0.0)))  # no negative zeros
    rows = rows.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")}).dropDuplicates(["vec_id", "h1", "h2"])
    rows = stage_table(rows, "vectors")
    lowest = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    classes = (
        rows.withColumn("place", lowest).filter(F.col("place") <= k + 1)
        .groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.any_value("x").alias("x"))
    )
    classes = stage_table(classes.withColumns({"class": F.monotonically_increasing_id(), "dim": F.size("x")}), "vector-classes")
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    queries = stage_table(queries.join(classes.select("h1", "h2", "class"), ["h1", "h2"]).select("query_id", "class"), "queries")
    asked = stage_table(classes.join(queries.select("class").distinct(), "class").select(F.col("class").alias("asked"), F.col("x").alias("qx"), "dim"), "asked")

    found, held = [], [rows, asked]
    for dim in [r["dim"] for r in classes.select("dim").distinct().collect()]:  # vector lengths: one, as a rule
        own, ask = classes.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim)
        sample = own.orderBy("h1", "h2").select("x").limit(SAMPLE).toArrow().column("x").combine_chunks()
        codes = fit_codes(sample.values.to_numpy().reshape(-1, dim), k)
        n = own.count()
        layout = _layout(own, codes, n)
        near = stage_table(_search(own, ask, codes, layout, codes.radius, k), "near-classes")
        enough = near.groupBy("asked").count().filter(F.col("count") >= min(k + 1, n)).select("asked")
        lacking = ask.join(enough, "asked", "left_anti")
        if lacking.isEmpty():
            found.append(near)
        else:
            found += [near.join(enough, "asked"), _search(own, lacking, codes, layout, MAX_BITS, k)]
        held.append(near)
    if not found:
        discard(*held)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    best = best.withColumn("vec_id", F.explode("ids")).drop("ids")
    order = Window.partitionBy("asked").orderBy("score", "vec_id")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    lists = best.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("list"))
    answers = queries.join(lists, F.col("class") == F.col("asked")).select("query_id", F.slice(F.filter("list", lambda c: c["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return answers.select("query_id", F.posexplode("list").alias("pos", "c")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(rows, -1)


def _layout(own: DataFrame, codes: Codes, n: int) -> Layout:
    """Count the classes of each substring's leading bits: at most 4 x 65536 numbers, whatever the table."""
    bits = min(SUBSTRING, max(0, (n // GROUP_ROWS).bit_length()))
    held = own.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((held.value.count, 1 << bits), np.int64)
        for batch in batches:
            subs = held.value.substrings(_matrix(batch.column("x"), batch.num_rows)).astype(np.int64) >> (SUBSTRING - bits)
            for j in range(held.value.count):
                total[j] += np.bincount(subs[:, j], minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["slot", "n"])

    counts = np.zeros(codes.count << bits, np.int64)
    for slot, size in own.select("x").mapInArrow(releasing(run), "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = size
    return Layout(counts.reshape(codes.count, -1), bits, GROUP_ROWS)


def _lots(ask: DataFrame, codes: Codes, layout: Layout, radius: int) -> np.ndarray:
    """In how many lots the queries of each group come, by counts of them: a number for each group of the index."""
    held = ask.sparkSession.sparkContext.broadcast((codes, layout))
    groups = int(layout.pieces.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, layout = held.value
        total = np.zeros(groups, np.int64)
        for batch in batches:
            for code in codes.substrings(_matrix(batch.column("qx"), batch.num_rows)):
                total[layout.probed(code, radius // codes.count)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    lots = np.ones(groups, np.int64)
    counts = ask.select("qx").mapInArrow(releasing(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for at, n in counts.filter(F.col("n") > QUERY_ROWS).collect():  # a row for a group at most
        lots[at] = -(-n // QUERY_ROWS)
    return lots


def _search(own: DataFrame, ask: DataFrame, codes: Codes, layout: Layout, radius: int, k: int) -> DataFrame:
    """(class asked, ids found, score): the nearest classes of every group that a query probes."""
    lots = _lots(ask, codes, layout, radius)
    first = np.cumsum(lots) - lots
    held = own.sparkSession.sparkContext.broadcast((codes, layout, lots, first))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, layout, lots, first = held.value
        for batch in batches:
            subs, salt = codes.substrings(_matrix(batch.column("x"), batch.num_rows)), batch.column("class").to_numpy()
            for j in range(codes.count):
                group = layout.group(j, subs[:, j], salt)
                for lot in range(int(lots[group].max(initial=0))):
                    rows = np.flatnonzero(lots[group] > lot)
                    at, names = pa.array(rows), group[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(first[names] + lot), pa.array(names), batch.column("ids").take(at), batch.column("x").take(at)], ["lot", "group", "ids", "x"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, layout, lots, first = held.value
        for batch in batches:
            subs, name = codes.substrings(_matrix(batch.column("qx"), batch.num_rows)), batch.column("asked").to_numpy()
            for i, code in enumerate(subs):
                groups = layout.probed(code, radius // codes.count)
                row = pa.array(np.full(len(groups), i))
                yield pa.RecordBatch.from_arrays([pa.array(first[groups] + (name[i] + groups) % lots[groups]), batch.column("asked").take(row), batch.column("qx").take(row)], ["qlot", "asked", "qx"])

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("asked", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not index.num_rows or not asked.num_rows:
            return schema.empty_table()
        codes, layout = held.value[:2]
        j = layout.substring_of(index.column("group")[0].as_py())
        ids, name = index.column("ids").combine_chunks(), asked.column("asked").to_numpy()
        queries, vectors = _matrix(asked.column("qx"), asked.num_rows), _matrix(index.column("x"), index.num_rows)
        parts = []
        for q, (rows, d) in zip(name, search_group(queries, vectors, codes, j, radius, k + 1), strict=True):
            parts.append(pa.record_batch([pa.array(np.full(len(rows), q)), ids.take(pa.array(rows)), pa.array(d)], schema=schema))
        return pa.Table.from_batches(parts, schema)

    index = own.select("class", "ids", "x").mapInArrow(releasing(dealt), "lot long, group long, ids array<long>, x array<double>")
    asked = ask.select("asked", "qx").mapInArrow(releasing(sent), "qlot long, asked long, qx array<double>")
    return index.groupBy("lot").cogroup(asked.groupBy("qlot")).applyInArrow(releasing_groups(run), "asked long, ids array<long>, score double")
