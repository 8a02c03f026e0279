import pytest

import __spark_entry__ as entry
from hirelens.plans import registry
from tests.compare import assert_same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), SF, registry.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
