"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from sourceloom import code_queries, queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    found = duck.execute(queries.ORACLES[name])
    assert canonical(df.collect(), df.columns) == canonical(found.fetchall(), [d[0] for d in found.description])


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hot_joins_have_equality_keys(spark, sf):
    """Containment joins are hash or merge joins on the group, not nested loops."""
    for name in ("containment_parent", "nearest_owner", "effect_owner", "qname_chain", "nearest_def_by_name"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_scans_read_only_needed_columns(spark, sf):
    plan = queries.QUERIES["latest_by_path"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]
