"""Every registered query at the smallest scale, against DuckDB where SQL can say it."""

import os

import pytest

from checks.compare import duck, verdict
from seriesmill.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    found = duck(SF).execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert verdict(df.columns, [tuple(r) for r in df.collect()], columns, found.fetchall()) == "ok"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
