"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from oracle import check, connect
from regionflow.plans.catalog import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RUNS = {name: q.run for name, q in catalog().items()}
SQL = {name: q.sql for name, q in catalog().items() if q.sql is not None}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, con, name):
    problem, n, *_ = check(spark, con, RUNS[name], SQL.get(name), SF_DIR)
    assert problem is None


def test_every_query_has_sql():
    assert set(SQL) == set(RUNS)
