"""Customers whose balance is zero, so that the places have coordinates of zero: every table still survives the CSV files."""

import datetime as dt

import pytest

from starloom.sources.conform import raw_table
from starloom.verification.queries import QUERIES, plain
from tests.conftest import rows

DAY = dt.datetime(1996, 5, 4)
TABLES = {
    "nation": ("n_nationkey int, n_name string", [(0, "NORTH"), (1, "SOUTH")]),
    "customer": (
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double",
        [(0, "zero", 0, 0.0), (1, "minus zero", 1, -0.0), (2, "rounds to zero", 1, 0.004), (3, "cent", 0, -0.01), (4, None, None, None)],
    ),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(0, "a, b", 0), (1, "", 1)]),
    "part": (
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
        [(0, "ring", "Brand#1", "LARGE", 1), (1, "bolt", "Brand#2", "ECONOMY", 2), (2, "nut", "Brand#2", None, None)],
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
        [(k, k % 5, "FOP"[k % 3], DAY, f"{k}-LOW") for k in range(7)],
    ),
    "lineitem": (
        """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,
        l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
        [(k % 7, k % 3, k % 2, 1 + k // 7, 3.0, 0.0 if k % 4 else 10.5, 0.0, 0.01 * k, "N", "O", DAY) for k in range(12)],
    ),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("zero-balance"))
    for name, (ddl, data) in TABLES.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_zero_coordinates_survive_in_any_session(spark, folder, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = rows(QUERIES["csv_geolocation"](spark, folder))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert [row[1:4] for row in got] == [
        (0.0, 0.0, "zero"), (0.0, 0.0, "minus zero"), (0.0, 0.0, "rounds to zero"), (-0.01, 0.01, "cent"), (None, None, None),
    ]


# The places are one of the nine inputs of a load, so a zero among them stopped the reload of every table.
RELOADED = [
    "customers",
    "geolocation",
    "order_reviews",
    "order_payments",
    "order_items",
    "orders",
    "sellers",
    "product_category_translation",
]


@pytest.mark.parametrize("table", RELOADED)
def test_a_reload_with_zero_coordinates_keeps_every_row(spark, folder, table):
    want = rows(plain(raw_table(spark, folder, table)))
    assert want
    assert rows(QUERIES[f"reloaded_{table}"](spark, folder)) == want
