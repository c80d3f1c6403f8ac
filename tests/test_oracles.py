"""Every registered query with an oracle, run next to DuckDB on the smallest tables."""

import os

import pytest
from check_queries import compare, oracle_connection

from poolwise.plans import load_all

SF_DIR = "/root/testdata/sf0.001"
QUERIES = load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize(
    "name", sorted(QUERIES)
)
def test_query_equals_oracle(spark, connection, name):
    query = QUERIES[name]
    ok, _, note = compare(spark, connection, SF_DIR, query.build, query.oracle)
    assert ok, note


def test_every_entry_is_exported():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert {n for n, q in QUERIES.items() if q.oracle} <= set(entry.oracle_sql())
