"""Every registered query of the subpackage, beside its oracle where it has one."""

import pytest
from check_queries import compare, oracle_connection

from poolwise.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, _, note = compare(spark, oracle_connection(SF), SF, QUERIES[name], ORACLES.get(name))
    assert ok, note
