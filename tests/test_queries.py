"""Every registered query at the smallest scale, against DuckDB where SQL can say it."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import registry
from checks.compare import duck, verdict

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert verdict(df.columns, rows, columns, found.fetchall()) == "ok"


def test_oracles_have_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
