import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from starloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "starloom-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Build a DataFrame from a DDL schema and rows, spread over several partitions."""

    def build(ddl, *rows, partitions=3):
        return spark.createDataFrame(list(rows), ddl).repartition(partitions)

    return build


def rows(df, *order):
    """Collected rows as tuples, sorted with NULLs first (by ``repr`` when no columns are given)."""
    if order:
        return [tuple(r) for r in df.orderBy(*order).collect()]
    return sorted((tuple(r) for r in df.collect()), key=repr)
