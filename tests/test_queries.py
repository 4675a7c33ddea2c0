"""Every query with SQL gives DuckDB's rows; the others give rows that keep their invariants."""

import pytest
from compare import connect, difference

from cloudloom.queries import aggregates, angles, coding, projections, slicing, spatial, streams, surfaces  # noqa: F401
from cloudloom.queries.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "n_pts" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
