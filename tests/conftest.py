import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("4")
    yield spark
    spark.stop()


@pytest.fixture
def frame(spark):
    """Rows and a DDL schema to a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def plan_of(df) -> str:
    """The physical plan; scans are named by their schema, as paths may be cut."""
    return df._jdf.queryExecution().executedPlan().toString()


def values(df, *columns):
    """Sorted tuples of the chosen columns (all by default)."""
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
