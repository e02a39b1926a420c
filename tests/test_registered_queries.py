"""Every registered query gives the rows of its SQL on the driver tables."""

import pytest

from checks import registry
from checks.compare import compare, connect

QUERIES, ORACLE = registry.merged("QUERIES"), registry.merged("ORACLE")


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    ok, note = compare(spark, duck, sf_dir, name, QUERIES[name], ORACLE[name])
    assert ok, note


def test_entry(spark):
    from __spark_entry__ import entry

    frame = entry(spark)
    assert frame.columns == ["login", "event_count_30d", "active_days_30d", "capabilities_touched_30d"]
    assert 0 < frame.count() <= 50
