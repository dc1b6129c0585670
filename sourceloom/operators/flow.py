"""Control-flow blocks and edges from keyword tokens, and facts about written names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.functions import fixed
from sourceloom.functions import text as T
from sourceloom.functions.ids import content_id


def _block_id(index: Column | int) -> Column:
    return content_id("cfg:block", F.col("fn_id"), F.lit(index) if isinstance(index, int) else index)


def _places(tokens: DataFrame) -> list[str]:
    """path, start and end, if the tokens have them."""
    return [c for c in ("path", "start", "end") if c in tokens.columns]


def with_blocks(tokens: DataFrame, cap: int = fixed.BLOCK_CAP) -> DataFrame:
    """Number the tokens (fn_id, pos, keyword) of each function from 2 and name their blocks.

    Blocks 0 and 1 are entry and exit; tokens beyond the cap are marked ``cut``.
    """
    index = F.row_number().over(Window.partitionBy("fn_id").orderBy("pos", "keyword")) + 1
    out = tokens.withColumn("block_index", index)
    return out.withColumns({"block_id": _block_id(F.col("block_index")), "cut": F.col("block_index") >= cap})


def blocks(tokens: DataFrame, functions: DataFrame | None = None, cap: int = fixed.BLOCK_CAP) -> DataFrame:
    """fn_id, block_id, kind (entry, exit, normal), keyword of every function that has tokens, and of ``functions`` (fn_id).

    If both have path, start and end, so have the blocks: a token's place, or the function's.
    """
    place = _places(tokens)
    ends = tokens.select("fn_id").distinct() if functions is None else functions.select("fn_id", *place).distinct() if place else tokens.select("fn_id").union(functions.select("fn_id")).distinct()
    none = F.lit(None).cast("string").alias("keyword")
    kept = with_blocks(tokens, cap).filter(~F.col("cut")).select("fn_id", "block_id", F.lit("normal").alias("kind"), "keyword", *place)
    for index, kind in ((0, "entry"), (1, "exit")):
        kept = kept.union(ends.select("fn_id", _block_id(index), F.lit(kind), none, *place))
    return kept


def edges(tokens: DataFrame, functions: DataFrame | None = None, cap: int = fixed.BLOCK_CAP) -> DataFrame:
    """fn_id, kind, src, dst, label: sequence, labelled branches, jumps and the fall through to exit.

    A function of ``functions`` without tokens falls through from entry to exit.
    Edges have the places of their tokens, or functions, if these have any.
    """
    place = _places(tokens)
    kept = with_blocks(tokens, cap).filter(~F.col("cut"))
    order = Window.partitionBy("fn_id").orderBy("block_index")
    last = F.lead("block_id").over(order).isNull()

    def edge(kind: str, src: Column, dst: Column, label: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), (none if label is None else label).alias("label"))

    block, word = F.col("block_id"), F.col("keyword")
    found = F.array(
        edge("seq", F.coalesce(F.lag("block_id").over(order), _block_id(0)), block),
        F.when(word.isin(*fixed.LABEL_KEYWORDS), edge("branch", block, _block_id(1), word)),
        F.when(word.isin(*fixed.JUMP_KEYWORDS), edge("jump", block, _block_id(1), word)),
        F.when(last, edge("fallthrough", block, _block_id(1))),
    )
    listed = kept.withColumn("found", found)  # the windows share one sort
    out = listed.select("fn_id", *place, F.explode(F.filter("found", lambda e: e.isNotNull())).alias("e")).select("fn_id", "e.*", *place)
    if functions is not None:
        empty = functions.select("fn_id", *place).distinct().join(tokens.select("fn_id").distinct(), "fn_id", "left_anti")
        out = out.union(empty.select("fn_id", *place, edge("fallthrough", _block_id(0), _block_id(1)).alias("e")).select("fn_id", "e.*", *place))
    return out.withColumn("edge_id", content_id("cfg:edge", F.col("fn_id"), F.col("src"), F.col("dst"), F.coalesce("label", "kind")))


def counts(tokens: DataFrame, cap: int = fixed.BLOCK_CAP) -> DataFrame:
    """Blocks and edges of each function: edges = tokens + branches + jumps + 1."""
    kept = with_blocks(tokens, cap).filter(~F.col("cut"))
    n = F.count("*")
    return kept.groupBy("fn_id").agg(
        (n + 2).alias("blocks"),
        (n + F.count_if(F.col("keyword").isin(*fixed.LABEL_KEYWORDS)) + F.count_if(F.col("keyword").isin(*fixed.JUMP_KEYWORDS)) + 1).alias("edges"),
    )


def cut_functions(tokens: DataFrame, cap: int = fixed.BLOCK_CAP) -> DataFrame:
    """fn_id, dropped of functions with more tokens than blocks are made for."""
    n = F.count("*") - (cap - 2)
    return tokens.groupBy("fn_id").agg(n.alias("dropped")).filter("dropped > 0")


def last_values(facts: DataFrame) -> DataFrame:
    """fn_id, name, value: the last write of each name in (fn_id, name, value, pos)."""
    return facts.groupBy("fn_id", "name").agg(F.max_by("value", "pos").alias("value"))


def _ends(rows: DataFrame) -> list[str]:
    return ["end"] if "end" in rows.columns else []


def written_facts(written: DataFrame) -> DataFrame:
    """fn_id, name, pos, op_kind, src, dst, flags of assignments (fn_id, name, expression, pos) to names like paths.

    A joined path or URL is normalised (CALL_NORM); else literals are folded (ASSIGN).
    """
    rows = written.filter(T.is_pathlike(F.col("name")))
    rows = rows.withColumns({"normal": T.normalize_call(F.col("expression")), "folded": T.fold_concat(F.col("expression"))})
    partly = F.when(F.contains("normal", F.lit("{x}")), F.array(F.lit("NON_LITERAL_PATH"))).otherwise(F.array().cast("array<string>"))
    literal = F.concat(F.lit("lit:"), F.left(F.coalesce("normal", "folded.value"), F.lit(64)))
    dynamic = F.col("normal").isNull() & (F.col("folded.flags")[0] == "DYNAMIC")
    return rows.select(
        "fn_id", "name", "pos", F.when(F.col("normal").isNotNull(), "CALL_NORM").otherwise("ASSIGN").alias("op_kind"), F.when(dynamic, F.lit("dyn:{x}")).otherwise(literal).alias("src"),
        F.concat(F.lit("var:"), "name").alias("dst"), F.when(F.col("normal").isNotNull(), partly).otherwise(F.col("folded.flags")).alias("flags"), *_ends(written),
    )


def used_facts(facts: DataFrame, called: DataFrame) -> DataFrame:
    """USE facts: names with a known value in calls (fn_id, call, preview, pos) of their function that hold the name."""
    known = facts.filter("src <> 'dyn:{x}'").select("fn_id", "name").distinct()
    joined = called.join(known, "fn_id").filter(F.contains("preview", F.col("name")))
    return joined.select("fn_id", "name", "pos", F.lit("USE").alias("op_kind"), F.concat(F.lit("var:"), "name").alias("src"), F.col("call").alias("dst"), F.array().cast("array<string>").alias("flags"), *_ends(called))


def numbered_facts(facts: DataFrame, cap: int = fixed.FACT_CAP) -> DataFrame:
    """Facts with fact_id and ``seq`` from 0: writes in the order of the text, then uses; those beyond the cap are marked ``cut``."""
    order = Window.partitionBy("fn_id").orderBy(F.col("op_kind") == "USE", "pos", "name", "dst")
    out = facts.withColumn("seq", F.row_number().over(order) - 1)
    return out.withColumns({"fact_id": content_id("dfg:fact", F.col("fn_id"), F.col("seq")), "cut": F.col("seq") >= cap})
