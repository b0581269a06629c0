"""The registered queries: names, columns, and results against SQL in another database.

All queries are compared when CHECK_ALL is set; otherwise a few that are quick to run.
``python check_queries.py`` does the same on larger tables.
"""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
import check_queries

SF = "/root/testdata/sf0.001"
QUICK = [
    "sanitize_documents", "resolve_external", "mask_custom_config", "policy_decisions", "sanitize_payloads",
    "reuse_accounting_split", "detection_report", "authorize", "redact_fields", "train_calibrator", "semantic_scores",
]
NAMES = list(spark_entry.oracle_sql()) if os.environ.get("CHECK_ALL") else QUICK


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in check_queries.TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    yield con
    con.close()


def test_every_check_belongs_to_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
    without = set(spark_entry.queries()) - set(spark_entry.oracle_sql())
    assert all(name.startswith("op") or name == "pipeline" for name in without)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, database, name):
    df = spark_entry.queries()[name](spark, SF)
    mine = [tuple(r) for r in df.collect()]
    cursor = database.execute(spark_entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert check_queries.rows_of(df.columns, mine) == check_queries.rows_of(columns, cursor.fetchall())


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.count() == 200
    assert "action_taken" in df.columns
