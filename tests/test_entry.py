import os

import pytest

import __spark_entry__ as entry
import jobs.queries
from planarflow import queries, table_queries

QUERIES = queries.QUERIES | table_queries.QUERIES | jobs.queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | table_queries.ORACLE_SQL | jobs.queries.ORACLE_SQL

DATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {n for n in QUERIES if n.endswith(("K2_6", "K3_4"))}


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    out = [tuple(None if r[i] is None else round(float(r[i]), 6) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("the given tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE_SQL[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), [c[0] for c in want.description])


def test_entry_is_the_flagship(spark):
    assert tuple(entry.entry(spark).first()) == (6, 6)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name,columns", [("stat_counts_by_type", "event_type"), ("stat_topk", "o_orderkey,o_totalprice"), ("text_hash_bucket", "text"), ("stat_sums_by_two", "o_custkey,o_orderstatus,o_orderpriority")])
def test_scans_read_what_is_needed(spark, name, columns):
    if not os.path.isdir(DATA):
        pytest.skip("the given tables are not here")
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    (schema,) = {line.split("ReadSchema: struct<")[1].split(">")[0] for line in plan.splitlines() if "ReadSchema" in line}
    assert [c.split(":")[0] for c in schema.split(",")] == columns.split(",")


def test_filters_reach_the_scan(spark):
    if not os.path.isdir(DATA):
        pytest.skip("the given tables are not here")
    plan = QUERIES["stat_in_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan or "PushedFilters: [IsNotNull(value), In(event_type" in plan
