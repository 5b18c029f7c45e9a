"""Every registered query against its SQL on the smallest tables."""

import pytest

from sparktrail.plans import registry
from sparktrail.plans.check import compare

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        ok, note = compare(df, ORACLES[name], data)
        assert ok, note
    else:
        assert df.count() > 0
