"""Every registered query against its SQL on the smallest supplied tables."""

import os

import pytest

import __spark_entry__ as entry_points
from tests import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables missing")
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    fn = entry_points.queries()[name]
    if name not in ORACLES:
        assert fn(spark, SF).count() > 0
        return
    assert compare.differences(spark, duck, name, fn, ORACLES[name], SF) in (None, "both empty")


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry_points.queries())
