"""Every query with an SQL twin against that twin."""

import pytest

from loomframe.plans import ORACLE, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    same, note = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert same, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_and_repeats(spark, name):
    first = sorted(map(repr, QUERIES[name](spark, SF).collect()))
    again = sorted(map(repr, QUERIES[name](spark, SF).collect()))
    assert first and first == again
