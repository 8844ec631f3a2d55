"""Every registered book query gives the rows of its SQL."""

import pytest

from bookengine.plans.catalog import ORACLES, QUERIES
from compare import DATA, assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    if name not in ORACLES:
        assert df.count() >= 0
        return
    found = duck.execute(ORACLES[name])
    assert_same(df, [c[0] for c in found.description], found.fetchall())


def test_entry(spark, duck):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
