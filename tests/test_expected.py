"""Every registered query against its SQL on the smallest given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as registered
from compare import database, differences

from conftest import plan_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no given tables")


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


LIBRARY = sorted(n for n in registered.queries() if n != "pipeline" and not n.startswith("op"))


def test_same_keys():
    assert set(LIBRARY) == {n for n in registered.oracle_sql() if n in LIBRARY}


@pytest.mark.parametrize("name", LIBRARY)
def test_query(spark, connection, name):
    df = registered.queries()[name](spark, FOLDER)
    plan = plan_of(df)
    assert not any(word in plan for word in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas"))
    assert differences(df, connection, registered.oracle_sql()[name]) is None


def test_entry(spark):
    assert registered.entry(spark).count() > 0
