"""The inverted index over the texts that rules need gives what trying every rule gives."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import effects

PATTERNS = {
    r"abc": "abc", r"^app\.get\(": "app.get(", r"ab?c": "c", r"ab*cde": "cde", r"a+bc": "bc", r"(abc)?de": "de", r"[xyz]{2}longest.tail": "longest", r"a|b": "", r"(?i)abc": "", r"\d+abc": "abc", r"\x41bc": "", r"a{0,2}": "",
    r"f\\\.g": r"f\.g", r"(a(b(c)))d": "d", r"[]ab]cd": "cd", r".*": "", r"x\{1\}y": "x{1}y", r"$end": "end", r"\$\w+\.query": ".query", r"ab??cc": "cc",
}


def test_texts_that_expressions_need(spark):
    rows = spark.createDataFrame([(p,) for p in PATTERNS], "p string").select("p", effects.required_literal(F.col("p")).alias("v")).collect()
    assert {r.p: r.v for r in rows} == PATTERNS


@pytest.mark.parametrize("seed", range(2))
def test_index_equals_trying_all(spark, seed, monkeypatch):
    r = random.Random(seed)
    words = ["get", "post", "run", "query", "a", "ab", "é", "session", "db", "$x"]

    def spec():
        text = ".".join(r.choices(words, k=r.randint(1, 3)))
        return r.choice([None, text, text.replace(".", " . "), "re:" + re.escape(text), "re:^" + re.escape(text) + r"\(", "re:(get|post)", "re:" + re.escape(text).replace("e", "e?")])

    rules = [("p", None, f"r{i}", r.choice(["any", "python", "javascript"]), r.choice(["any", "python"]), "rpc", "x", "", 0.9, r.choice(["call", "decorator", "class"]), spec(), spec() if i % 3 == 0 else None, r.choice([None, 1]), None, [], None) for i in range(120)]
    rules = spark.createDataFrame([*rules, *rules[:9]], effects.RULE_SCHEMA)
    calls = [(i, r.choice(["python", "javascript", "typescript"]), ".".join(r.choices(words, k=r.randint(1, 4))) + "(x)", r.randint(0, 2)) for i in range(300)] + [(900, "python", "", 0), (901, "python", "a(", 1)]
    calls = spark.createDataFrame(calls, "call_id long, language string, preview string, n_args int")
    plain, indexed = ({(x.call_id, x.rule_id) for x in effects.matched(calls, rules, index).collect()} for index in (False, True))
    assert plain == indexed and len(plain) > 50
    monkeypatch.setattr(effects, "MAX_RULE_ROWS", 5)  # shuffled, not broadcast
    large = effects.matched(calls, rules, True)
    assert {(x.call_id, x.rule_id) for x in large.collect()} == plain


def test_many_rules_are_keyed_by_their_parts(spark, monkeypatch):
    monkeypatch.setattr(effects, "MAX_RULE_ROWS", 5)
    monkeypatch.setattr(effects, "INDEX_FROM", 5)
    rules = spark.range(2000).select(*[F.lit(v).alias(c) if c != "callee" else F.concat(F.lit("call"), F.col("id").cast("string"), F.lit("(")).alias(c) for c, v in (("pack", "p"), ("tag", "t"), ("rule_id", "r"), ("language", "any"), ("pattern_language", "any"), ("kind", "rpc"), ("provider", "x"), ("family", ""), ("confidence", 0.9), ("pattern_kind", "call"), ("callee", None))])
    rules = rules.selectExpr("*", "CAST(NULL AS STRING) object_method", "CAST(NULL AS INT) arg_min", "CAST(NULL AS INT) arg_max", "CAST(array() AS array<struct<name:string,source:string,index:int,key:string,value_expr:string>>) fields", "CAST(NULL AS STRING) file_regex").withColumn("rule_id", F.col("callee"))
    calls = spark.range(3000).select(F.col("id").alias("call_id"), F.lit("python").alias("language"), F.concat(F.lit("x.call"), F.col("id").cast("string"), F.lit("()")).alias("preview"), F.lit(0).alias("n_args"))
    found = effects.matched(calls, rules)
    assert {(r.call_id, r.rule_id) for r in found.collect()} == {(i, f"call{i}(") for i in range(2000)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_rarest" in plan and "Cartesian" not in plan


def test_texts_are_listed_once_and_under_long_parts(spark, monkeypatch):
    """A thousand calls of each of a thousand names: lists of three letters would hold all of them."""
    monkeypatch.setattr(effects, "INDEX_FROM", 5)
    made: dict[str, int] = {}
    staged = effects.stage_table

    def counting(df, name):
        table = staged(df, name)
        made[name] = table.count()
        return table

    monkeypatch.setattr(effects, "stage_table", counting)
    rules = spark.range(1000).select(F.format_string(r"re:^client\.?c%04d\.r[a-z]+\(", "id").alias("callee"), F.format_string("r%d", "id").alias("rule_id"))
    fixed = {"pack": "p", "language": "any", "pattern_language": "any", "kind": "rpc", "pattern_kind": "call", "arg_min": 0}
    rules = rules.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])
    rules = rules.selectExpr(*[f"CAST({c if c in rules.columns else 'NULL'} AS {t}) AS {c}" for c, t in (x.split(" ", 1) for x in effects.RULE_SCHEMA.split(", "))])
    calls = spark.range(100_000).select(F.col("id").alias("call_id"), F.lit("python").alias("language"), F.format_string("clientc%04d.run(1)", F.col("id") % 1000).alias("preview"), F.lit(1).alias("n_args"))
    found = effects.matched(calls, rules)
    assert found.count() == 100_000 and found.filter("rule_id <> concat('r', call_id % 1000)").count() == 0
    assert made["call-parts"] <= 3000
