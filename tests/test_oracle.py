"""Every query with SQL agrees with it on the smallest tables."""

from __future__ import annotations

import pytest

from orebed.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import DATA
from tests.parity import assert_same, duck

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def test_every_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
