"""Every query of the core runs, and equals its SQL where it has one."""

import pytest
from compare import assert_same, connect

from plumbline.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert_same(df, connect(sf), ORACLES[name])
    else:
        assert df.columns and df.count() > 0


def test_entry_and_catalog(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
