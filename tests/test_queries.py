"""Every registered query beside its oracle SQL on the smallest tables."""

import pytest
from compare import database, differences

from millrace import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    if name in ORACLES:
        assert differences(spark, sf, QUERIES[name], ORACLES[name], db) == ""
    else:
        assert QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["window_start", "window_end", "event_type", "n", "rk"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
