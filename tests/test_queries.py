import duckdb
import pytest

import __spark_entry__ as entry
from starloom.verification.oracle import ORACLE
from starloom.verification.queries import QUERIES
from tests.conftest import SMALL
from verify_local import TABLES, _rows

CHEAP = [
    "fact_orders", "fact_order_items", "fact_reviews", "fact_reviews_split", "lookup_manifest", "lookup_unpartitioned", "month_window_partitioned", "monthly_revenue", "cohort_retention", "top_sellers",
    "late_rate", "rfm", "rfm_search", "published_fact_reviews", "reloaded_orders", "reloaded_order_items", "review_delay", "check_orphans", "check_primary_keys", "csv_order_reviews",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_sql(spark, db, name):
    got = entry.queries()[name](spark, SMALL)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLE)


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["purchase_month", "monthly_revenue", "mom_change_pct", "moving_avg_3mo"]
