import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from variform.plans.catalogue import QUERIES as CATALOGUE
from variform.plans.oracles import oracles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_of_the_catalogue_has_sql():
    assert set(oracles()) == set(CATALOGUE)


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query_equals_its_sql(spark, con, name):
    def build(spark, sf_dir):
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
        return df

    difference, rows, _, _ = compare(spark, con, name, build, ORACLES[name], SF_DIR)
    assert difference is None
    assert rows > 0


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["k"] == 10 and len(row["sample"].split(",")) == 10
