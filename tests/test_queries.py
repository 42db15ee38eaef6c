import math

import duckdb
import pytest

import __spark_entry__ as entry
from foliomill.plans.catalog import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(float(value)) if isinstance(value, float) else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert QUERIES.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    found = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert found == table(columns, cursor.fetchall()) and found


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"isolated_faults", "export_and_scan", "folder_run", "page_engine_results", "registry_engine", "guarded_rows", "faulty_export"}))
def test_plans_have_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas", "PythonUDF", "BatchEvalPython"):
        assert unwanted not in plan


def test_path_queries_read_no_text(spark, sf_dir):
    for name in ("scan_filter", "extension_filter", "target_collisions", "skip_existing"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        scans = [p.split(">")[0] for p in plan.split("ReadSchema: struct<")[1:]]
        assert scans and all("text:" not in s for s in scans), name
