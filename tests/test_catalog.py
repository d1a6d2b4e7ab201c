"""Every query of the catalogue against its SQL."""

import pytest

from codestrata.plans.catalog import QUERIES
from compare import differs, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_as_sql(spark, con, name):
    f, sql = QUERIES[name]
    assert differs(f(spark, SF).toPandas(), con.execute(sql).df()) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
