import pytest

import __spark_entry__ as entry
from pitbars.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
