"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__
from ledgerspark import registry

SF = "/root/testdata/sf0.001"
#: The whole way from text to facts is one plan for all report queries; these cover it.
REPORTS = {"layout_detect", "statement_facts", "merged_statement", "tidy_evidence"}
LONG = {"page_split", "table_extract", "html_grid", "statement_meta", "cross_foot_statements", "catalog_rows", "report_documents", "facts_coverage"}


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - LONG))
def test_rows_match(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert len(rel.columns) == len(cols)
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_every_report_query_has_sql():
    assert REPORTS | LONG <= set(registry.oracle_sql())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "doc_id", "score", "rank"] and df.count() > 0


def test_conditions_reach_the_scan(spark):
    plan = registry.queries()["facts_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey)" in plan and "EqualTo(o_custkey,7)" in plan
