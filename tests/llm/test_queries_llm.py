import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from variform.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
TABLES = {"op3_chat": "conversations", "op7_html": "pages"}


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    difference, rows, _, _ = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert difference is None and rows > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n != "op6_mixing"])
def test_one_row_per_row(spark, name):
    rows = spark.read.parquet(f"{SF_DIR}/{TABLES.get(name, 'documents')}.parquet").count()
    assert QUERIES[name](spark, SF_DIR).count() == rows
