"""Every registered query against its SQL in DuckDB; those without SQL have rows and a stable schema, and tests of their own."""

from __future__ import annotations

import math

import duckdb
import pytest

from corvane.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert columns and rows and columns == sorted(catalogue.QUERIES[name](spark, sf_dir).columns)
        return
    got = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == columns
    at = [got.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in got.fetchall())


def test_oracles_belong_to_queries():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_top_k_is_cut_before_the_shuffle(spark, sf_dir):
    plan = catalogue.QUERIES["bm25_topk"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
