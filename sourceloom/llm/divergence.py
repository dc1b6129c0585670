"""Source divergence audit by count-cell ranking.

How far a source's words are from those of the other sources of its language is a
sum, and a top list, of a function of two counts.  Terms with the same two counts
have the same value, so terms are first grouped into cells of (count, count) with
their number, and the function is evaluated once for each cell.

* Pairs of sources: a cell's value counts as often as the cell has terms.  Only
  terms that both sources have are joined; cells in which a count is 0 follow by
  inclusion and exclusion from the sources' own cells, so terms that are missing
  somewhere are never listed.
* Top terms: cells with equal values are merged, ranked by value, and only those
  that begin within the first ten terms are expanded to terms, in UTF-8 order.

Terms are counted with numpy and Arrow dictionaries on bounded chunks of the texts'
bytes; all else is DataFrame operations on tables of terms, cells and sources.
All numbers are integers: products of counts are decimals, values fit 64 bits.

Defined results: null and empty texts have no terms, but their group takes part;
null languages and sources are ``''``; repeated rows are separate documents; a
language with one source has no pairs; a language without kept terms has pairs of
value 0 and no term rows; an empty table gives no rows; only text, lang and
source are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import discard, releasing, row_chunks, stage_table, text_buffers
from sourceloom.llm.words import LOWER, runs

MIN_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000

#: Bytes of terms: ASCII letters, and all bytes of other characters.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


def chunk_terms(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of the texts; and the text, the term (its place) and the count of all that occur in each text."""
    flags = IS_LETTER[data]
    starts, ends = runs(flags, offs)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(LOWER[data[flags]])])
    coded = flat.dictionary_encode()
    text_of = np.searchsorted(offs, starts, side="right") - 1
    keys, counts = np.unique(text_of * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
    texts, terms = np.divmod(keys, max(1, len(coded.dictionary)))
    return coded.dictionary, texts, terms, counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences) and docs of each chunk's groups."""
    for batch in batches:
        data, offs = text_buffers(batch.column("text"))
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
        for i, j in row_chunks(offs):
            names, texts, terms, counts = chunk_terms(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            if not len(names):
                continue
            keys, inverse, docs = np.unique(group[i:j][texts] * len(names) + terms, return_inverse=True, return_counts=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, inverse, counts)
            groups, of = np.divmod(keys, len(names))
            lang, source = np.divmod(groups, len(sources.dictionary))
            columns = [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), names.take(pa.array(of)).cast(pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _probability(count: Column | int, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly."""
    count = F.lit(count).cast("long") if isinstance(count, int) else count
    above = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + 2 * terms).cast("decimal(19,0)")
    whole = F.call_function("div", above, F.when(below > 0, below))  # decimals divide to a whole number
    return whole.cast("long") + 1


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are about SCALE at most, so squares fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, lang_n, sources (array of source and n): terms in at least ``least`` documents of their language."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = rows.mapInArrow(releasing(_counted), "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return by_term.filter(F.col("docs") >= least).select("lang", "term", "lang_n", "sources")


def groups_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, total (of the group), lang_total, terms (the language's number of them) of every group that occurs."""
    pairs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    languages = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    totals = terms.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("total"))
    found = pairs.join(languages, "lang", "left").join(totals, ["lang", "source"], "left")
    return found.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "terms")])


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of all pairs of sources of a language, either way round."""
    listed = F.array_sort("sources")
    both = terms.select("lang", listed.alias("l")).select("lang", "l", F.posexplode("l").alias("at", "a"))
    both = both.select("lang", "a", F.explode(F.slice("l", F.col("at") + 2, F.size("l"))).alias("b"))
    both = both.groupBy("lang", F.col("a.source").alias("a"), F.col("b.source").alias("b"), F.col("a.n").alias("x"), F.col("b.n").alias("y")).agg(F.count("*").alias("m"))
    own = terms.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source"), F.col("s.n").alias("n")).agg(F.count("*").alias("m"))
    left, right = (groups.select("lang", F.col("source").alias(k), F.col("total").alias(f"{k}_total"), *extra) for k, extra in (("a", ["terms"]), ("b", [])))
    named = left.join(right, "lang").filter(F.col("a") < F.col("b"))  # the pairs that are asked for

    zero, m = F.lit(0).cast("long"), F.col("m")

    def cells(rows: DataFrame, *parts: tuple[Column, Column, Column]) -> DataFrame:
        """Rows of a pair as cells (x, y) with a number of terms, which may be negative."""
        listed = F.array(*[F.struct(x.alias("x"), y.alias("y"), n.cast("long").alias("m")) for x, y, n in parts])
        return rows.select("lang", "a", "b", F.explode(listed).alias("c")).select("lang", "a", "b", "c.*")

    x, y, n = F.col("x"), F.col("y"), F.col("n")
    parts = cells(both, (x, y, m), (x, zero, -m), (zero, y, -m), (zero, zero, m))
    parts = parts.union(cells(named.join(own.withColumnRenamed("source", "a"), ["lang", "a"]), (n, zero, m), (zero, zero, -m)))
    parts = parts.union(cells(named.join(own.withColumnRenamed("source", "b"), ["lang", "b"]), (zero, n, m), (zero, zero, -m)))
    parts = parts.union(cells(named, (zero, zero, F.col("terms"))))
    merged = parts.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")).filter("m <> 0").join(named, ["lang", "a", "b"])
    value = _distance(_probability(x, F.col("a_total"), F.col("terms")), _probability(y, F.col("b_total"), F.col("terms")))
    summed = merged.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * value).alias("value"))
    valued = named.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", zero))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return valued.select("lang", F.explode(sides).alias("s"), "value").select("lang", "s.source", "s.item", "value")


def top_terms(terms: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of each group's terms with the highest values among those more frequent than in the language."""
    rows = terms.select("lang", "term", "lang_n", F.explode("sources").alias("s")).select("lang", "term", "lang_n", "s.*")
    cells = rows.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("m")).join(groups, ["lang", "source"])
    p, q = _probability(F.col("n"), F.col("total"), F.col("terms")), _probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    cells = cells.withColumns({"p": p, "q": q}).filter("p > q").withColumn("value", _distance(F.col("p"), F.col("q")))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    values = values.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)  # each value has a term at least
    above = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("above", above).filter(F.col("above") < top).select("lang", "source", "value")
    kept = cells.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value")
    found = rows.join(kept, ["lang", "source", "n", "lang_n"])
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("term")))
    return found.withColumn("rank", place).filter(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    terms = stage_table(term_counts(docs, least), "divergence-terms")
    groups = stage_table(groups_of(docs, terms), "divergence-groups")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pair_values(terms, groups).withColumn("rank", place)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(top_terms(terms, groups, top).withColumn("part", F.lit("term")))
    found = stage_table(both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")), "divergence")
    discard(terms, groups)
    return found
