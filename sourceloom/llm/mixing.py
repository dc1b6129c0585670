"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

The sources' targets are turned into integer quotas of equal-token blocks by
giving each block to the highest quotient ``target / (2 * quota + 1)``.  Each
source is a seeded stream of its documents, cut into blocks of ``block``
tokens; a quota of whole passes takes every block, and what is left of it is a
run of blocks that starts at a seeded block and wraps around.

Defined results: null and empty texts have size 0 and take 0; a null source is
a source of its own, after all others; repeated rows are separate documents, and as
places come from a hash of id and text, only rows equal in both share one (so rows
without an id spread, and a mix takes the same texts in every run); an
empty table gives no rows; columns that clash with the working columns are kept
out, as only the id, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import discard, stage_table

TOKEN = r"[^\x20\x09-\x0D]+"
BLOCK = 64
SEED = 17
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Fewest and most digits of the hash that cut a source's stream into pieces for the
#: prefix sums, and the words from which a further digit is taken.
BUCKET_DIGITS, MOST_DIGITS = 3, 5
PIECE_WORDS = 4 << 20


def cyclic_weights(order: Column, weights: tuple[int, ...] = WEIGHTS) -> Column:
    """The weight of the source that stands at ``order`` (from 1)."""
    return F.element_at(F.array(*[F.lit(w) for w in weights]), ((order - 1) % len(weights) + 1).cast("int")).cast("long")


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source (``source, source_size, weight``).

    Shares by weight, none above ``max_epochs`` times its source; the excess
    goes to the others by weight until none is above.  That fixed point is the
    water level of the sources ordered by cap / weight.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("place").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = (
        sources.join(F.broadcast(total))  # one row
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        .withColumn("is_capped", F.col("weight") * F.col("rest") > F.col("cap") * F.col("open_weight"))
    )
    level = capped.filter(~F.col("is_capped")).agg(
        F.max(F.struct("rest", "open_weight")).alias("level")
    )  # rest never grows along the order: the largest is that of the first open source
    share = F.col("weight") * F.col("level.rest") / F.col("level.open_weight")
    return capped.join(F.broadcast(level)).withColumn(
        "target", F.when(F.col("is_capped"), F.col("cap").cast("double")).otherwise(share)
    )


def sainte_lague(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``quota``: the number of blocks that the highest quotients give each source.

    A slightly larger divisor gives a lower quota for every source at once; only
    the few blocks above it are dealt one by one, in all about five per source.
    """
    seats = sources.agg(
        F.round(F.sum("target") / block).cast("long").alias("seats"),
        F.sum("target").alias("total_target"),
        F.count("*").alias("n_sources"),
    )
    even = F.col("target") * F.greatest(F.col("seats") - F.col("n_sources"), F.lit(0)) / F.col("total_target")
    base = (
        sources.join(F.broadcast(seats))
        .withColumn("base", F.when(F.col("total_target") > 0, F.floor(even + 0.5)).otherwise(0).cast("long"))
        .withColumn("more", F.when(F.col("total_target") > 0, F.ceil(2 * F.col("n_sources") * F.col("target") / F.col("total_target")) + 2).otherwise(0).cast("long"))
    )
    given = base.agg(F.sum("base").alias("given"))
    quotients = (
        base.withColumn("seat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more"))))
        .withColumn("quotient", F.col("target") / (2 * (F.col("base") + F.col("seat")) + 1))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("quotient").desc(), F.col("place"), F.col("seat"))))
        .join(F.broadcast(given))
        .filter((F.col("rank") <= F.col("seats") - F.col("given")) & (F.col("target") > 0))
        .groupBy("place")
        .agg(F.count("*").alias("dealt"))
    )
    return base.join(quotients, "place", "left").withColumn("quota", F.col("base") + F.coalesce("dealt", F.lit(0))).drop("more", "base", "dealt")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, quota, taken.

    With ``carry``, a struct ``row`` of all the document's columns comes along.
    """
    extra = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # a null source has a name too
    size = F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")
    columns = ["doc_id", "source", name.alias("name"), size.alias("size"), key.alias("key")]
    narrow = stage_table(docs.select(*columns), "mix-sizes")
    sized = docs.select(*columns, *extra) if carry else narrow
    words = narrow.agg(F.sum("size")).first()[0] or 0
    digits = next((d for d in range(BUCKET_DIGITS, MOST_DIGITS) if words <= PIECE_WORDS << 4 * d), MOST_DIGITS)
    bucket = F.substring("key", 1, digits).alias("bucket")

    # small tables, written so that none is computed again
    along = Window.partitionBy("name").orderBy("bucket")
    pieces = narrow.groupBy("name", bucket).agg(F.sum("size").alias("piece_size"))
    pieces = pieces.select("name", "bucket", (F.sum("piece_size").over(along) - F.col("piece_size")).alias("piece_start"), F.sum("piece_size").over(Window.partitionBy("name")).alias("source_size"))
    pieces = stage_table(pieces, "mix-pieces")
    place = F.row_number().over(Window.orderBy(F.col("name") == "", "name"))
    sources = pieces.groupBy("name").agg(F.max("source_size").alias("source_size"))
    sources = stage_table(sources.withColumn("place", place).withColumn("weight", cyclic_weights(F.col("place"), weights)), "mix-sources")
    wanted = stage_table(targets(sources, max_epochs), "mix-targets")
    quotas = stage_table(sainte_lague(wanted, block).select("name", "target", "quota"), "mix-quotas")
    discard(sources, wanted)

    # Blocks of a source: whole passes first, then a seeded run of blocks.
    blocks = F.ceil(F.col("source_size") / block)
    plan = (
        pieces.join(quotas, "name")
        .select("name", "bucket", "piece_start", "source_size", "target", "quota", F.greatest(blocks, F.lit(1)).cast("long").alias("blocks"))
        .withColumn("passes", F.least(F.floor(F.col("quota") / F.col("blocks")), F.lit(max_epochs)).cast("long"))
        .withColumn("run", F.when(F.col("passes") < max_epochs, F.col("quota") % F.col("blocks")).otherwise(0))
        .withColumn("run_start", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.substring("name", 2, 1 << 30))), 1, 8), 16, 10).cast("long"), F.col("blocks")))
    )

    within = Window.partitionBy("name", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("bucket", bucket).join(plan, ["name", "bucket"])  # one shuffle for this and the sums
    placed = placed.withColumn("lo", F.col("piece_start") + F.sum("size").over(within) - F.col("size"))
    hi = F.col("lo") + F.col("size")

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.least(hi, b) - F.greatest(F.col("lo"), a), F.lit(0))

    first, last = F.col("run_start") * block, (F.col("run_start") + F.col("run")) * block
    wrapped = last - F.ceil(F.col("source_size") / block) * block
    taken = F.col("passes") * F.col("size") + overlap(first, last) + overlap(F.lit(0), wrapped)
    return placed.select("doc_id", "source", "size", "source_size", "target", "quota", taken.cast("long").alias("taken"), *(["row"] if carry else []))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each as often as its taken words are its size, rounded."""
    mixed = mix(docs, carry=True, **options).filter("taken > 0")
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    return mixed.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("row.*")
