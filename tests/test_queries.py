"""Every registered query beside its SQL on the small tables."""

import os

import pytest

from emberlog.plans.oracles import ORACLES
from emberlog.plans.queries import QUERIES
from tests.check_queries import compare, database

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    count, problem, _, _ = compare(spark, con, SF_DIR, name)
    assert problem is None
    assert count > 0
